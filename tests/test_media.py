from pyspark.sql import functions as F

from rosterlab.functions import fixed_values as fv
from rosterlab.operators import media
from tests.conftest import rows

DEFAULT = fv.DEFAULT_MEDIA_PATH


def paths(spark):
    return spark.createDataFrame([("Alpha", "new/alpha.png"), ("delta", "new/d.png")],
                                 "name string, path string")


def test_enrich_uses_the_default_for_unlisted_names(spark, world):
    got = media.media_enrich(world["unit"].select("unit_id", "name"), paths(spark))
    assert rows(got.where("unit_id < 3"), "unit_id", "media_path") == [
        (1, "new/alpha.png"), (2, DEFAULT),
    ]


def test_backfill_never_touches_a_set_path(spark, world):
    got = media.media_backfill(world["unit"], paths(spark))
    assert got.columns == world["unit"].columns
    assert dict(rows(got, "unit_id", "media_path")) == {
        1: "a.png", 2: DEFAULT, 3: DEFAULT, 4: "new/d.png", 5: "x/alpha.png", 6: DEFAULT, 7: DEFAULT,
        8: DEFAULT, 9: DEFAULT,
    }
    again = media.media_backfill(got, paths(spark))
    assert rows(again) == rows(got)


def test_kind(spark):
    df = spark.createDataFrame(
        [(t,) for t in ["http://a", " HTTPS://b", "data:image/png;", "httpx", "a/b.png", " ", None]],
        "p string",
    )
    assert [r["media_kind"] for r in media.media_kind(df, "p").collect()] == [
        "remote", "remote", "remote", "file", "file", "none", "none",
    ]


def test_resolve_takes_the_first_listed_candidate(spark):
    items = spark.createDataFrame(
        [(1, " https://x/y.png "), (2, "a.png"), (3, "b.png"), (4, "/abs.png"), (5, "gone.png"),
         (6, None), (7, "/gone.png"), (8, "a.png")],
        "id int, p string",
    )
    stored = ["a.png", "assets/a.png", "assets/b.png", "/abs.png", DEFAULT, "assets//gone.png"]
    manifest = spark.createDataFrame([(p,) for p in stored], "path string")
    got = dict(rows(media.media_resolve(items, manifest, "id", "p")))
    assert got == {
        1: "https://x/y.png", 2: "a.png", 3: "assets/b.png", 4: "/abs.png", 5: DEFAULT, 6: DEFAULT,
        7: DEFAULT, 8: "a.png",
    }
    nothing = manifest.where(F.col("path") == "a.png")
    got = dict(rows(media.media_resolve(items, nothing, "id", "p")))
    assert got == {1: "https://x/y.png", 2: "a.png", 8: "a.png", **dict.fromkeys((3, 4, 5, 6, 7))}


def test_url(spark):
    df = spark.createDataFrame([("m1",)], "id string")
    assert df.select(media.media_url(F.col("id"), "https://host.invalid/").alias("u")).first()["u"] == (
        "https://host.invalid/m1.png"
    )


def test_repeated_names_do_not_repeat_items(spark):
    from rosterlab.operators.media import media_backfill

    units = spark.createDataFrame([(1, "a", None), (2, "b", "set")], "unit_id int, name string, media_path string")
    paths = spark.createDataFrame([("a", "y"), ("a", "x")], "name string, path string")
    got = sorted((r["unit_id"], r["media_path"]) for r in media_backfill(units, paths).collect())
    assert got == [(1, "x"), (2, "set")]
