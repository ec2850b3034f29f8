"""Operators on small fixtures against brute force: nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import (decontaminate, licenses, line_dedup, near_dedup, packing, queries, secrets,
                            token_files, top_k, toxicity, warc)
from cohortlens.llm.automaton import LANE, Automaton
from cohortlens.llm.common import words
from cohortlens.llm.graph import components
from cohortlens.llm.license_texts import NOTICES

public_tokenizers = pytest.importorskip("public_tokenizers")
rng = np.random.default_rng(5)
VOCABULARY = ["".join(rng.choice(list("abcdefgé"), rng.integers(2, 7))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


LONG = prose(30_000, 1)
TEXTS = [None, "", " ", "one", "two  spaces and\n\nblank lines ", prose(300, 2), prose(300, 2), LONG,
         "# token: 'abcdEFGH1234' é " + "f" * 40 + " AKIA" + "Z" * 20, " tab\tand <|endoftext|> 😀 "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i % 2, "kept") for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 0, "kept"), (3, "one", "x", 1, "kept")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score int, at string")


def empty(docs):
    return docs.where("1 = 0")


# 1 ------------------------------------------------------------------ secrets
def spans_by_re(text):
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def test_secret_spans_match_regular_expressions(spark, docs):
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abc", "ABCDEFGH12", "é", "AKIA",
             "AKIAZ", "0123456789abcdef", "f" * 31, "\n", "passwd", "tok", "Z" * 12, "x=", "😀", "K"]
    gen = np.random.default_rng(3)
    texts = ["".join(gen.choice(parts, gen.integers(1, 30))) for _ in range(600)]
    texts += ["x" * (LANE - 5) + "token=" + "a" * (2 * LANE) + " end", "é" * LANE + "secret: abcdefgh"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + TEXTS)], "doc_id long, text string")
    for r in secrets.scan(rows, rules=secrets.BASE_RULES).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == spans_by_re(r["text"] or ""), r["text"]
    assert secrets.scan(docs).columns == docs.columns + ["spans"]
    assert secrets.scan(empty(docs)).count() == 0


def test_automaton_is_minimal_and_finds_ends():
    a = Automaton(["ab+", "(x|y)z?", "q{2,}"], [False] * 3, search=True)
    data = np.frombuffer(b"abb xz qqq AB", np.uint8)
    ends, marks = a.ends(data, 0xFF)
    assert list(zip(ends.tolist(), marks.tolist(), strict=True)) == [(2, 1), (3, 1), (5, 2), (6, 2), (9, 4), (10, 4)]
    assert len(Automaton(["a|b", "a|b"], [False] * 2).next) == 3


# 3, 8 ------------------------------------------------------------------ tokens
def whole_ids(name, text):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_token_files_round_trip(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write(docs, path, f"file://{tmp_path}/files", length=64)
    rows = token_files.read(spark, manifest).orderBy("start").collect()
    want = sorted(docs.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in want]
    start = 0
    for r, w in zip(rows, want, strict=True):
        ids = whole_ids("byte_bpe_50k.json", w["text"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.write(empty(docs), path, f"file://{tmp_path}/none").count() == 0


def test_sequences_by_number(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write(docs, path, f"file://{tmp_path}/files", length=16).orderBy("part").collect()
    reader = token_files.Sequences([r["path"] for r in files], [r["n_ids"] for r in files])
    own = [np.concatenate([ids[mask.to_numpy(zero_copy_only=False)] for ids, mask in
                           (reader[i] for i in range(reader.first[k], reader.first[k + 1]))]) for k in range(len(files))]
    assert [len(x) for x in own] == [r["n_ids"] for r in files] and len(reader) > 256 * 4
    want = sorted(docs.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    assert np.array_equal(np.concatenate(own), np.concatenate([whole_ids("byte_bpe_50k.json", r["text"]) for r in want]))
    assert all(len(reader[i][0]) == len(reader[i][1]) == 16 for i in (0, 255, 256, len(reader) - 1))
    with pytest.raises(IndexError):
        reader[len(reader)]
    assert len(token_files.Sequences([], [])) == 0


def test_packing_keeps_every_id_once(spark, docs):
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for key, t in text.items():
        ids = whole_ids("word_bpe_49k.json", t)
        mine = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == key)
        copies = sum(r["doc_id"] == key for r in docs.collect())
        mine = mine[::copies]
        assert [m[0] for m in mine] == np.cumsum([0] + [m[1] for m in mine])[:-1].tolist()
        assert sum(m[1] for m in mine) == len(ids) == mine[0][3]
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c, _ in mine)
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 4096
    assert packing.pack(empty(docs), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_bins_of_a_class_have_its_count():
    p = packing.Packer(0)
    rows = [r for i in range(400) for r in p.add(i, np.full(1365, i, np.int32))]
    assert len({r[5] for r in rows}) == 133 and len(rows) == 399
    left = list(p.close())
    assert sum(r[2] for r in left) == 1365 and all(r[2] & (r[2] - 1) == 0 for r in left)


def test_waiting_pieces_hold_their_own_ids_only():
    p = packing.Packer(0)
    list(p.add(1, np.arange(4096 * 50 + 1365, dtype=np.int32)))
    waiting = [piece[3] for pieces in p.open.values() for piece in pieces]
    assert [len(w) for w in waiting] == [1365] and all(w.base is None for w in waiting)


# 5 ------------------------------------------------------------------ toxicity
def test_toxicity_learns_on_training_rows_only(spark):
    rows = [(i, prose(40, i) + (" grumble" if i % 3 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert 0 < len(model.index) < 5000
    got = toxicity.score(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).where("h").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got]) > 0.97
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5) == 0 for r in got)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped)
    assert np.array_equal(model.weight, again.weight)
    none = toxicity.train(docs, labels.where("1 = 0"))
    assert {r["score"] for r in toxicity.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), none).collect()} == {0.5}


def test_ftrl_by_hand():
    gen = np.random.default_rng(3)
    rows = [np.append(np.unique(gen.integers(1, 30, 6)), 0).astype(np.int32) for _ in range(80)]
    labels = np.array([float(3 in r or 4 in r) for r in rows])
    p = toxicity.Ftrl(alpha=0.7, beta=1.5, l1=0.4, l2=0.1, epochs=3)
    z, n = {}, {}

    def weight(i):
        own, l1 = z.get(i, 0.0), 0 if i == 0 else p.l1
        return 0.0 if abs(own) <= l1 else -(own - np.sign(own) * l1) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for r, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in r.tolist()}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old ** 0.5) / p.alpha * w[i]
    got = toxicity.fit_rows(rows, labels, p)
    assert np.allclose(got[:30], [weight(i) if i in z else 0 for i in range(30)]) and not got[30:].any() and 0 < (got[1:30] == 0).sum() < 29


def test_a_labelled_id_of_many_rows_is_learned_from_once(spark):
    rows = [(i, prose(30, i) + (" grumble" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    fit = lambda extra: toxicity.train(spark.createDataFrame(rows + extra, "doc_id long, text string"), labels)
    once, often = fit([]), fit([rows[7]] * 500)
    assert len(once.index) and np.array_equal(once.index, often.index) and np.array_equal(once.weight, often.weight)


def test_a_piece_is_looked_up_once_a_block_however_often_it_occurs():
    import public_tokenizers

    from cohortlens.llm.tokens import WordEncoder

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            Counted.asked += 1
            return super().__getitem__(k)

    texts = ["the cat, sat. on\nthe mat " * 2000, "", "a\0b c", " ", "\n", ",", "x", "the  cat ,. sat", "mat,\n\nmat.", "é ü. \u2003z"] * 2
    for file in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = WordEncoder(public_tokenizers.path(file))
        e.number = Counted()
        Counted.asked = 0
        for ids, bounds in e.encode(pa.array(texts)):
            own = [ids[bounds[i]:bounds[i + 1]].tolist() for i in range(len(bounds) - 1)]
            assert own == [e.library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert Counted.asked < 200                       # of some 30,000 pieces


# 4 ------------------------------------------------------------------ decontamination
def test_decontamination_finds_what_overlaps(spark, docs):
    items = [(i, prose(30, 1000 + i) + ". " + prose(8, 2000 + i)) for i in range(40)]
    items += [(98, prose(400, 3001)), (99, None), (100, ""), (7, items[7][1])]
    rows = [(i, prose(200, i)) for i in range(30)]
    for i in range(0, 30, 3):
        rows[i] = (i, prose(150, i) + " " + items[i][1].upper() + " " + prose(90, i + 1))
    rows += [(500, prose(90, 7) + items[40][1] + "!"), (501, None), (502, ""), (503, items[3][1][:80])]
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], h["item_id"]) for r in got.collect() for h in r["hits"]}
    assert found == {(i, i) for i in range(0, 30, 3)} | {(500, 98)}
    none = decontaminate.matches(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.columns == docs.columns + ["hits"] and {len(r["hits"]) for r in none.collect()} == {0}


def test_short_items_match_brute_force(spark):
    gen = np.random.default_rng(11)
    items = [(n * 10 + j, " ".join(gen.choice(VOCABULARY, n, replace=False))) for n in range(1, 15) for j in range(3)]
    items += [(200, "What is the capital of France? Paris."), (201, "x = 7 - 3 = 4"), (202, "f(x)!")]
    tokens = lambda t: re.findall(r"\w+", t.lower())
    texts = [f"{prose(30, 500 + i)} {t.upper()}, {prose(20, 600 + i)}" for i, (_, t) in enumerate(items)]
    texts += ["What is the capital of Spain? Madrid.", "x = 7 - 3", items[-1][1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.matches(rows, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], h["item_id"]) for r in got for h in r["hits"]}
    grams = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}

    def held(t, item):
        parts = [tokens(p) for p in decontaminate.halves(item)]
        own = [grams(p, min(5, len(p))) if p else set() for p in parts]
        hit = [len(o & grams(tokens(t), min(5, len(p)))) if p else 0 for o, p in zip(own, parts, strict=True)]
        n = sum(map(len, own))
        return all(x >= 0.5 * len(o) for x, o in zip(hit, own, strict=True)) and sum(hit) >= 0.8 * n

    verbatim = {(d, i) for d, t in enumerate(texts) for i, x in items if f" {' '.join(tokens(x))} " in f" {' '.join(tokens(t))} "}
    assert {(i, k) for i, (k, _) in enumerate(items)} <= verbatim <= found
    assert found == {(d, i) for d, t in enumerate(texts) for i, x in items if held(t, x)}
    assert len(texts) - 3 not in {d for d, i in found if i == 200} and len(texts) - 2 not in {d for d, i in found if i == 201}


def test_a_question_without_its_answer_is_no_leak(spark):
    question, answer = prose(40, 71) + "?", prose(8, 72)
    texts = [prose(30, 73) + " " + question + " " + a + " " + prose(30, 74) for a in (answer, prose(8, 75), "")]
    got = decontaminate.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                                spark.createDataFrame([(1, question + " " + answer)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["hits"]} == {0}


def test_block_max_search_gives_plain_bm25(spark):
    gen = np.random.default_rng(21)
    items = [(i, " ".join(gen.choice(VOCABULARY[:120], int(gen.integers(3, 150))))) for i in range(50)]
    texts = [" ".join(gen.choice(VOCABULARY[:150], int(gen.integers(1, 260)))) for _ in range(25)]
    texts += [f"{prose(20, i)} {x} {prose(31, i + 1)}" for i, x in items[:25]]
    index, = decontaminate.indexes(spark.createDataFrame(items, "item_id long, text string"))
    stride, size, k1, b = decontaminate.STRIDE, decontaminate.PASSAGE_WORDS, decontaminate.K1, decontaminate.B
    split = {i: x.split() for i, x in items}
    df = {w: sum(w in own for own in split.values()) for own in split.values() for w in own}
    mean = np.mean([len(x) for x in split.values()])
    want = {}
    for i, own in split.items():
        for at in range(0, len(own), stride):
            entry = own[at:at + stride]
            score = {w: np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * entry.count(w) * (k1 + 1)
                     / (entry.count(w) + k1 * (1 - b + b * len(entry) / mean)) for w in entry}
            whole = sum(score.values())
            for r, t in enumerate(texts):
                t = t.split()
                for start in range(0, len(t), stride):
                    found = sum(score.get(w, 0) for w in set(t[start:start + size])) / whole
                    if found >= 0.5:
                        want[r, i] = max(want.get((r, i), 0), found)
    h, row = words(pa.array(texts))
    got = decontaminate.search(index, h, row, 0.5)
    assert {(r, int(index.item_id[i])): pytest.approx(s) for (r, i), s in got.items()} == want and len(want) > 25


def test_index_shards_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(30, 1000 + i)) for i in range(30)], "item_id long, text string")
    rows = spark.createDataFrame([(i, prose(20, i) + " " + prose(30, 1000 + i)) for i in range(12)], "doc_id long, text string")
    key = lambda df: sorted((r["doc_id"], h["item_id"]) for r in df.collect() for h in r["hits"])
    one = key(decontaminate.matches(rows, items))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1500)
    assert key(decontaminate.matches(rows, items)) == one == [(i, i) for i in range(12)]


# 2 ------------------------------------------------------------------ near duplicates
def test_near_duplicates(spark):
    base = [prose(200, i) for i in range(12)]
    rows = list(enumerate(base))
    for i in range(6):
        words = base[i].split()
        words[50], words[120] = "changedone", "changedtwo"
        rows.append((100 + i, " ".join(words)))
        rows.append((200 + i, base[i].upper() + " !"))
    rows += [(300, ""), (301, None), (302, "  "), (303, LONG), (304, LONG + " end"), (None, "x"), (0, base[0])]
    got = {r["doc_id"]: r for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len({i for i, _ in rows if i is not None})
    for i in range(6):
        assert got[i]["class_id"] == got[100 + i]["class_id"] == got[200 + i]["class_id"] == i
        assert got[200 + i]["representative"] == i and got[100 + i]["representative"] == 100 + i
    assert all(got[i]["class_id"] == i for i in range(6, 12))
    assert {got[i]["class_id"] for i in (300, 301, 302)} == {300} and got[304]["class_id"] == 303
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_dedup_finds_every_link_in_a_bucket_of_many_classes(spark):
    """Documents that share most of a passage, so that many classes meet in a bucket: classes and links
    as a brute-force search over all pairs gives them, chains that pass by the centre among them."""
    gen = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in gen.integers(0, 10**9, n)]
    passage, texts = word(150), []
    for _ in range(40):
        own = word(60)
        texts.append(passage + own)
        for _ in range(int(gen.integers(0, 4))):              # each changes a little of the one before
            own = own[:-6] + word(6) if gen.random() < 0.5 else word(9) + own[9:]
            texts.append(passage + own)
    rows = [(i * 3, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    idf = near_dedup.document_frequency(docs.select("text"))
    sets = []
    for _, t in rows:
        h, _, w = near_dedup.weighted(*near_dedup.shingles(*near_dedup.words(pa.array([t]))), idf)
        sets.append(dict(zip(h.tolist(), w.tolist(), strict=True)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = sum(min(w, sets[j][h]) for h, w in sets[i].items() if h in sets[j])
            if common / (sum(sets[i].values()) + sum(sets[j].values()) - common) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}
    assert 10 < len(set(got.values())) < len(rows)


def test_sample_agreement_estimates_weighted_jaccard():
    sampler, gen = near_dedup.Sampler(), np.random.default_rng(1)
    h = np.sort(gen.integers(0, 1 << 63, 900).astype(np.uint64))
    w = gen.uniform(0.5, 3, 900).astype(np.float32)
    w2 = np.where(np.arange(900) % 9 == 0, w * 2, w).astype(np.float32)
    a, b = h[:800], h[100:]
    x, y = sampler.sample(a, w[:800], np.array([0]))[0], sampler.sample(b, w2[100:], np.array([0]))[0]
    low = np.minimum(w[100:800], w2[100:800]).sum()
    true = low / (w[:800].sum() + w2[100:].sum() - low)
    assert abs((x == y).mean() - true) < 0.17


def test_components(spark):
    gen = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in gen.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}


def test_edges_of_pieces():
    from cohortlens.llm import tokens
    rng = random.Random(33)
    pieces = ["", " ", "\n", ",", ".", " .", "a", " a", "é", " é", "\x1c", " \x85x", "x\u3000", "\u00a0", "²", " x,", "  y"]
    pieces += ["".join(rng.choices(" \n\t\x1f,.aZ0é²\u2009\u3000中", k=rng.randint(0, 4))) for _ in range(2000)]
    bare = [p[1:] if p[:1] == " " else p for p in pieces]
    want = [[p == "\n" or q != "" and not q[0].isspace() and not q[-1].isspace() for p, q in zip(pieces, bare, strict=True)],
            [p[-1:].isalnum() for p in pieces], [p in (",", ".") for p in pieces], [p in ("\n", "") for p in pieces]]
    assert [x.tolist() for x in tokens._edges(pieces)] == want


def test_rare_shingle_rows_are_narrow(spark, monkeypatch):
    made, write = {}, near_dedup.staged

    def seen(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(near_dedup, "staged", seen)
    monkeypatch.setattr(near_dedup, "release", lambda df: None)
    own = [prose(200, 300 + i).split() for i in range(8)]
    texts = [(10 * i + j, " ".join(w[:100] + ["changed", str(j)] + w[100:])) for i, w in enumerate(own) for j in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    idf = spark.sparkContext.broadcast(near_dedup.document_frequency(docs.select("text")))
    open_rows = docs.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("c"), F.lit(-1).cast("long").alias("ca"),
                            *[F.lit(0).cast("long").alias(f"s{i}") for i in range(4)])
    got = {(r["a"], r["b"]) for r in near_dedup.rest(open_rows, docs, idf, 0.8).collect()}
    assert got == {(10 * i + a, 10 * i + b) for i in range(8) for a, b in ((0, 1), (0, 2), (1, 2))}
    # one row a document with its bitmap; a shingle's row has a folded one. Before, each shingle's row had the whole
    assert made["rare-shingles"].count() == len(texts)
    assert len(made["shared-shingles"].columns) <= 6 + 4 + near_dedup.FOLDED


# 9 ------------------------------------------------------------------ lines
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def deduped(rows, k, least=20):
    seen, out = [], {}
    order = [(i, p, ln) for i, t in sorted(rows) for p, ln in enumerate((t or "").split("\n")) if ln.strip(" ")]
    keep = set()
    for i, p, ln in order:
        exact = any(ln == s for s in seen)
        near = len(ln) >= least and any(len(s) >= least and abs(len(s) - len(ln)) <= k and distance(s, ln) <= k for s in seen)
        if not exact and not near:
            keep.add((i, p))
        if not exact:
            seen.append(ln)
    for i, t in rows:
        out[i] = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or (i, p) in keep)
    return out


@pytest.mark.parametrize("k", [1, 2])
def test_lines_match_brute_force(spark, k):
    gen = np.random.default_rng(k)
    pool = [prose(int(gen.integers(3, 9)), 50 + i) for i in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for ln in gen.choice(pool, 5):
            c = list(ln)
            for _ in range(gen.integers(0, 4)):
                at = int(gen.integers(0, len(c)))
                c[at:at + int(gen.integers(0, 2))] = ["z"] * int(gen.integers(0, 2))
            lines.append("".join(c))
        rows.append((i, "\n".join(lines + ["", "short"])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, LONG[:1500] + "\n" + LONG[:1500] + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("first", F.lit(2))
    got = line_dedup.dedupe(docs, max_edits=k, counts="n")
    assert got.columns == docs.columns + ["n"]
    result = {r["doc_id"]: r for r in got.collect()}
    want = deduped(rows, k)
    assert {i: r["text"] for i, r in result.items()} == want
    assert sum(r["n"]["near"] for r in result.values()) > 0
    assert line_dedup.dedupe(empty(docs)).count() == 0


def test_near_lines_by_length_match_brute_force(spark):
    gen = np.random.default_rng(8)
    bands = line_dedup.MAX_EDITS
    lines = []
    for i in range(60):
        w = prose(int(gen.integers(4, 60)), 900 + i).split()
        if i % 5 == 0:
            w = ["".join(w)]                                         # no words: segments only
        lines.append(" ".join(w))
        for _ in range(3):
            v, at = list(w), int(gen.integers(0, len(w)))
            change = gen.integers(0, 4)
            if change == 0:
                v[at:at] = [v[at]]
            elif change == 1:
                v[at] = str(gen.choice(VOCABULARY))
            elif change == 2 and len(v) > 1:
                del v[at]
            c = list(" ".join(v))
            for _ in range(gen.integers(0, 9) if change == 3 or i % 5 == 0 else gen.integers(0, 2)):
                at = int(gen.integers(0, len(c)))
                c[at:at + int(gen.integers(0, 2))] = list(gen.choice(list("z é"), int(gen.integers(0, 2))))
            lines.append("".join(c))
    lines += ["the cat sat on the mat and then the dog came in and sat too", "the cat sat on on the mat and then the dog came in and sat too"]
    lines = list(dict.fromkeys(x for x in lines if x.strip()))

    def near(x, y):
        k = max([e for least, e in bands if min(len(x), len(y)) >= least], default=-1)
        return abs(len(x) - len(y)) <= k and distance(x, y) <= k

    want = [x for i, x in enumerate(lines) if not any(near(x, y) for y in lines[:i])]
    assert len(want) < len(lines) - 60 and lines[-1] not in want
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = [r["text"] for r in line_dedup.dedupe(rows).orderBy("doc_id").collect()]
    assert got == [x if x in want else "" for x in lines]


def test_lines_that_share_a_segment_make_no_pairs(spark, monkeypatch):
    rng, made = random.Random(31), {}
    start = "these words begin every single one of the lines here "
    lines = [start + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(120)]
    lines += [lines[0][:80] + "#" + lines[0][81:]]
    write = line_dedup.staged

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "staged", counted)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in line_dedup.dedupe(docs, counts="n").collect()}
    assert [i for i, n in got.items() if n["near"]] == [120] and sum(n["links"] for n in got.values()) == 2
    # each of them has six segments and looks up some substrings; before, all 7,260 pairs were written
    assert max(made.values()) < 15 * len(lines)


def test_letters_bound_edits(spark):
    rng, rows = random.Random(32), []
    for _ in range(300):
        x = "".join(rng.choices("ab cdeé1789Z", k=rng.randint(30, 60)))
        y, d = list(x), rng.randint(0, 8)
        for _ in range(d):
            at = rng.randrange(len(y))
            kind = rng.random()
            y[at:at + 1] = [rng.choice("ab zé13Q")] if kind < .5 else [] if kind < .75 else [y[at], rng.choice("abz 7")]
        rows.append((x, "".join(y), d))
    pairs = spark.createDataFrame(rows, "x string, y string, d int").select(
        "x", "y", "d", F.array(*line_dedup.letters(F.col("x"))).alias("a"), F.array(*line_dedup.letters(F.col("y"))).alias("b"))
    for r in pairs.collect():
        differ = sum(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in zip(r["a"], r["b"], strict=True))
        assert differ <= 2 * r["d"] - abs(len(r["x"]) - len(r["y"]))


def test_lines_of_null_and_repeated_ids(spark):
    old, new = "the same old line of text here", "new words that stay in the text"
    rows = [(None, old), (1, f"{old}\n{new}"), (1, f"{old}\n{new}")]
    read = lambda rows: sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedupe(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # rows equal in doc_id and text are one document
    assert read(rows) == [(0, old), (1, new), (1, new)]
    # other rows with one doc_id are documents of their own: a line of two of them stays in one only
    other = "a first line that no other text has"
    for i in (None, 1):
        got = read([(i, f"{old}\n{new}"), (i, f"{other}\n{old}")])
        assert sorted(ln for _, t in got for ln in t.split("\n") if ln) == sorted([old, new, other])


def test_lines_with_clashing_names(spark):
    names = ["kp", "kn", "kl", "kd", "kh", "__ls", "__at", "row", "d", "h", "ls", "at", "first", "place", "id", "n"]
    docs = spark.createDataFrame([(1, "a line that two documents have"), (2, "a line that two documents have\nx")], "doc_id long, text string")
    docs = docs.select(*[F.lit(c).alias(c) for c in names], "doc_id", "text")
    got = line_dedup.dedupe(docs)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["text"] == "a line that two documents have" and rows[2]["text"] == "x" and all(rows[1][c] == c for c in names)
    counted = line_dedup.dedupe(docs, counts="n")
    assert counted.columns == [c for c in docs.columns if c != "n"] + ["n"] and {r["n"]["exact"] for r in counted.collect()} == {0, 1}


# 7 ------------------------------------------------------------------ licenses
def test_licenses_match_brute_force(spark, docs):
    rows = []
    for i, (name, notice) in enumerate(sorted(NOTICES.items())):
        for j, before in enumerate((0, 1, 7, 18, 33)):
            rows.append((i * 10 + j, prose(before, j) + " " + notice.upper() + "\n" + prose(40, i)))
        words = notice.split()
        rows.append((i * 10 + 6, " ".join(words[:len(words) // 2])))
        rows.append((i * 10 + 7, " ".join(words[:-1] + ["changed"])))
    rows += [(900, LONG + " " + NOTICES["mit"]), (901, None), (902, "")]
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(w[i:i + 5]) for w in [tokens(t)] for i in range(len(w) - 4)}
    want = {(i, n) for i, t in rows for n, v in NOTICES.items() if len(grams(t) & grams(v)) >= 0.8 * len(grams(v))}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), NOTICES).collect()
    assert {(r["doc_id"], x["name"]) for r in got for x in r["licenses"]} == want
    assert licenses.scan(docs, NOTICES).columns == docs.columns + ["licenses"] and licenses.scan(empty(docs), NOTICES).count() == 0


def test_licenses_of_the_common_families(spark):
    said = {"mit-line-licensed": "licensed under the MIT license", "cc-by-4.0-line": "Licensed under CC BY 4.0", "cc-by-sa-4.0-line": "licensed under CC-BY-SA 4.0",
            "mpl-2.0": NOTICES["mpl-2.0"], "isc": NOTICES["isc"], "unlicense": NOTICES["unlicense"], "agpl-3.0": NOTICES["agpl-3.0"],
            "lgpl-2.1": NOTICES["lgpl-2.1"], "gpl-2.0": NOTICES["gpl-2.0"], "cc0-1.0": NOTICES["cc0-1.0"], "bsd-3-clause": NOTICES["bsd-3-clause"],
            "bsd-2-clause": NOTICES["bsd-2-clause"], "gpl-2.0-spdx": "// SPDX-License-Identifier: GPL-2.0"}
    rows = spark.createDataFrame([(n, prose(20, 1) + " " + t + " " + prose(20, 2)) for n, t in said.items()], "doc_id string, text string")
    got = {r["doc_id"]: {x["name"] for x in r["licenses"]} for r in licenses.scan(rows, NOTICES).collect()}
    assert all(n in got[n] for n in said)
    assert "bsd-3-clause-names" in got["bsd-3-clause"] and "bsd-3-clause-names" not in got["bsd-2-clause"]


def test_ids_that_need_more_bits_are_refused(tmp_path):
    for wide in (False, True):
        w = token_files.Writer(f"file://{tmp_path}/{wide}", 0, 4, wide)
        w.add([1], np.array([65535, 65536, 2], np.int64), np.array([0, 3]))
        if wide:
            w.close()
        else:
            with pytest.raises(ValueError):
                w.close()


def test_revisit_validators_hops_and_ports(spark):
    rows = [(1, "http://a.org:80/x", 1, "response", "\"v\"", None, {"server": "s", "x": "1"}),
            (2, "https://a.org:443/x", 2, "revisit", "W/\"v\"", None, {"connection": "Keep-Alive, X-Hop", "keep-alive": "5", "x-hop": "h", "x": "2"}),
            (3, "http://a.org:443/x", 3, "revisit", "\"v\"", None, {}), (4, "a.org:8080/x", 4, "revisit", "\"v\"", None, {}), (5, None, 5, "revisit", "\"v\"", None, {"x": "3"})]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified long, headers map<string,string>")
    got = {r["record_id"]: r for r in warc.resolve(df).collect()}
    assert (got[2]["status"], got[2]["response_id"], got[2]["headers"]) == ("resolved", 1, {"server": "s", "x": "2"})
    assert {got[i]["status"] for i in (3, 4, 5)} == {"no_earlier_response"} and got[5]["headers"] == {"x": "3"}


# 6 ------------------------------------------------------------------ revisits
def test_revisits(spark):
    head = {"content-length": "9", "etag": "a"}
    rows = [(1, "http://www.A.org/x/#f", 10, "response", "a", None, head), (2, "https://a.org/x?utm_source=q", 9000, "revisit", "a", None, {"content-length": "0", "date": "d"}),
            (3, "a.org/x", 9001, "revisit", "b", None, {}), (4, "a.org/x", 5, "revisit", "a", None, None), (5, "a.org/y", 5, "revisit", "a", None, {}),
            (6, None, 7, "response", "a", None, head), (7, None, 8, "revisit", "a", None, {}), (8, "a.org/x", None, "revisit", "a", None, {}),
            (9, "a.org/z", 1, "response", None, 50, {}), (10, "a.org/z", 2, "revisit", "e", 50, {}), (11, "a.org/z", 3, "revisit", None, 51, {})]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified long, headers map<string,string>")
    got = {r["record_id"]: r for r in warc.resolve(df).collect()}
    assert {i: (r["status"], r["response_id"]) for i, r in got.items()} == {
        2: ("resolved", 1), 3: ("validator_mismatch", 1), 4: ("no_earlier_response", None), 5: ("no_earlier_response", None),
        7: ("no_earlier_response", None), 8: ("no_earlier_response", None), 10: ("resolved", 9), 11: ("validator_mismatch", 9)}
    assert got[2]["headers"] == {"content-length": "9", "etag": "a", "date": "d"} and got[2]["response_ts"] == 10
    assert {i: r["status"] for i, r in got.items()} == {r["record_id"]: r["status"] for r in warc.resolve(df, span=2).collect()}
    assert warc.resolve(df.where("1 = 0")).count() == 0


def test_pages_that_differ_have_their_own_history(spark):
    same = [("HTTP://WWW.A.org/x/?UTM_Source=q&ref=2#f", "a.org/x"), ("https://a.org/x?ref=1&a=2&sessionid=9", "a.org/x?a=2"),
            ("a.org/x?a=1&utm_b=2&ref=3&b=4", "a.org/x?a=1&b=4"), ("A.org", "a.org"), ("a.org?", "a.org"), (None, None),
            ("a.org/x?pref=1", "a.org/x?pref=1"), ("a.org/x?href=b&id=3", "a.org/x?href=b&id=3"), ("http://a.org/Page", "a.org/Page"),
            ("a.org/x?a=B", "a.org/x?a=B"), ("a.org/x?u=/b/", "a.org/x?u=/b/"), ("a.org/ref=1", "a.org/ref=1"), ("", "")]
    df = spark.createDataFrame([(u,) for u, _ in same], "url string").select("url", warc.canonical_url(F.col("url")).alias("k"))
    assert [(r["url"], r["k"]) for r in df.collect()] == same
    rows = []
    for i, (x, y) in enumerate([("a.org/x?pref=1", "a.org/x?pref=2"), ("b.org/Page", "b.org/page"), ("c.org/?href=b", "c.org/?href=c")]):
        rows += [(10 * i, x, 1, "response", "e1", None, {}), (10 * i + 1, y, 2, "response", "e2", None, {}), (10 * i + 2, x, 3, "revisit", "e1", None, {})]
    log = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified long, headers map<string,string>")
    assert {(r["record_id"], r["status"], r["response_id"]) for r in warc.resolve(log).collect()} == {(10 * i + 2, "resolved", 10 * i) for i in range(3)}


# 10 ----------------------------------------------------------------- top k
def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 150)
    gen = np.random.default_rng(9)
    rows = [(i, gen.normal(size=6).astype(float).tolist()) for i in range(500)]
    rows += [(500 + i, [0.5] * 6) for i in range(60)] + [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (702, [float("nan")] * 6),
             (703, [float("inf")] * 6), (704, [1.0, 2.0]), (720, [1e30] + [0.0] * 5), (None, [1.0] * 6), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    valid = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i not in (None, 700, 701, 702, 703, 720)}
    df = df.where("vec_id is null or vec_id <> 720")
    want = {}
    for q in (i for i in valid if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(valid[q], v, strict=True)), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))
        want[q] = [(i, -s) for s, i in scores[:20]]
    got = {}
    for r in top_k.top_k(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want
    assert top_k.top_k(df.where("1 = 0"), df, 3).count() == 0 and top_k.top_k(df, df.where("1 = 0"), 3).count() == 0


def test_top_k_of_empty_vectors(spark, monkeypatch):
    monkeypatch.setattr(top_k, "LEAF_ROWS", 4)
    rows = [(20, []), (40, [])] + [(i, []) for i in range(1, 12)] + [(60, [1.0]), (61, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k.top_k(df, df.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(q, i, 0) for q in (20, 40) for i in (1, 2, 3)] + [(60, 61, 64 * 128)]


# all ---------------------------------------------------------------- queries
def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, sf)
        assert new.columns == docs.columns, name
        new = spark.createDataFrame(new.collect(), docs.schema)
        assert 0 < new.count() <= docs.count()
        docs = new
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    import duckdb
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("pages", "embeddings", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    cursor = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})")
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(cursor.fetchall(), key=key)


def test_pairs_of_similar_samples_pass_the_filter(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0, 0), (0x1111111, 0, 0, 0, 0, 0, 0, 0), (-1, -1, 0, 0, 0, 0, 0, 0)],
                                 ", ".join(f"{x}s{i} long" for x in "ab" for i in range(4)))
    assert [r[0] for r in rows.select(near_dedup.similar_enough("a", "b")).collect()] == [True, True, False]


