"""Run registered queries on Spark and their oracle SQL on DuckDB; report differences.

Usage: python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.session import build_session  # noqa: E402
from cohortlens.plans import registry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    registry.load_all()
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, fn in registry.QUERIES.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            spdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        sql = registry.ORACLE.get(name)
        if sql is None:
            print(f"rows {name}: {len(spdf)} rows ({dt:.1f}s) schema={sdf.schema.simpleString()[:200]}")
            continue
        try:
            rel = con.execute(sql)
            odf = rel.df()
            otypes = dict(zip([d[0] for d in rel.description], [str(d[1]) for d in rel.description]))
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        scols, srows = rows_of(spdf)
        ocols, orows = rows_of(odf)
        stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        msg = []
        if scols != ocols:
            msg.append(f"cols spark={scols} oracle={ocols}")
        if len(srows) != len(orows):
            msg.append(f"rows spark={len(srows)} oracle={len(orows)}")
        elif srows != orows:
            diff = [(a, b) for a, b in zip(srows, orows) if a != b]
            msg.append(f"{len(diff)} value diffs, first: {diff[:2]}")
        fam = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
               "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
        tdiff = {c: (t, otypes.get(c)) for c, t in stypes.items() if fam.get(t, t) != otypes.get(c)}
        if tdiff:
            msg.append(f"type families differ: {tdiff}")
        if msg:
            bad += 1
            print(f"FAIL {name} ({dt:.1f}s): " + "; ".join(msg))
            print(f"     types spark={stypes} oracle={otypes}")
        else:
            print(f"ok   {name}: {len(srows)} rows ({dt:.1f}s) types spark={stypes} oracle={otypes}")
    print(f"done, {bad} failing")


if __name__ == "__main__":
    main()
