"""Declarative mappings and file recognition on small frames with known answers."""

from pyspark.sql import functions as F

from tarsia.operators import mapping, publishing


def test_fields_in_odd_rows(spark):
    """Blank and null values give defaults, lookups take the greatest of several values, unmet conditions give null."""
    spec = mapping.TableSpec(
        "t",
        {
            "id": mapping.Field(("a", "b")),
            "who": mapping.Field(("k",), lookup=mapping.Lookup("names", "key", "name"), default="nobody"),
            "n": mapping.Field(("n",), transform="number", default="0"),
            "size": mapping.Field(("n",), transform="length"),
            "yes": mapping.Field(("y",), transform="boolean"),
            "part": mapping.Field(("a",), extract=r"-(\d+)", when={"y": ("yes",)}),
        },
        where={"kind": ("x",)},
        required=("id", "n"),
    )
    rows = [("p-7", None, "1", "1,234", "yes", "x"), (" ", "q", "2", "?", "NO", "x"), (None, None, None, None, None, "x"), ("r-8", None, "9", "5", "maybe", None)]
    export = spark.createDataFrame(rows, "a string, b string, k string, n string, y string, kind string")
    names = spark.createDataFrame([("1", "Ann"), ("1", "Bea"), ("2", ""), (None, "Zoe")], "key string, name string")
    got = {tuple(r.out) + (r.outcome,) for r in mapping.apply(spec, export, {"names": names}).collect()}
    assert got == {
        ("p-7", "Bea", "1234.0", "5", "true", "7", "stored"),
        ("q", "nobody", "0", "1", "false", None, "stored"),
        (None, "nobody", "0", "0", None, None, "missing id"),
        ("r-8", "nobody", "5.0", "1", None, None, "filtered"),
    }
    assert mapping.unused([spec], export.withColumn("z", F.lit(1))) == ["z"]
    assert mapping.apply(spec, export.limit(0), {"names": names}).count() == 0


def test_names_before_headers(spark):
    rows = [("Sla-cases", ["Alert ID"], "sla_policy"), ("x", ["TICKET id"], "case_record"), ("", [], None), (None, None, None)]
    got = spark.createDataFrame(rows, "stem string, headers array<string>, want string").withColumn("got", publishing.recognised(F.col("stem"), F.col("headers"))).collect()
    assert all(r.got == r.want for r in got)
