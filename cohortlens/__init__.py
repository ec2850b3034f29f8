"""cohortlens — student-risk analytics written as Spark DataFrame transforms.

Every operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``) built from ``pyspark.sql.functions`` expressions, so the
whole plan stays inside Catalyst and whole-stage codegen.
"""

__version__ = "0.1.0"
