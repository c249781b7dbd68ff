"""Collections read in splits, and spelling against a table of places."""

import json
import random

import pytest

from ridgewater.operators import spelling
from ridgewater.sources import geojson


def features(n):
    shape = {"type": "Polygon", "coordinates": [[[80 + i, 30.0] for i in range(3)] + [[80, 31.0]]]}
    return [{"type": "Feature", "properties": {"id": i, "note": 'a "Feature", {\\"type\\": no', "kind": "Feature"}, "geometry": shape} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_collections_are_split_between_tasks(spark, tmp_path, indent):
    folder = tmp_path / "layer"
    folder.mkdir()
    (folder / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": features(400), "more": [1]}, indent=indent))
    # Another writer's spacing, the type last, and a bare feature.
    (folder / "b.geojson").write_text(json.dumps({"features": [dict(reversed(list(f.items()))) for f in features(3)], "type": "FeatureCollection"}, separators=(",", ":")))
    (folder / "c.geojson").write_text(json.dumps(features(1)[0], indent=indent))
    (folder / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9973")
    try:
        read = geojson.read_polygons(spark, str(folder), "id")
        assert read.rdd.getNumPartitions() > 5
        got = read.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.polygon_id for r in got) == sorted(list(range(400)) + [0, 1, 2] + [0])
    assert all(r.properties["kind"] == "Feature" and len(r.rings[0]) == 4 for r in got)
    one = geojson.read_polygons(spark, str(folder / "a.geojson"), "id").orderBy("position").collect()
    assert [r.polygon_id for r in one] == list(range(400))


def test_broken_and_empty_collections(spark, tmp_path):
    text = json.dumps({"type": "FeatureCollection", "features": features(5)})
    path = tmp_path / "broken.geojson"
    path.write_text(text.replace('"id": 2', '"id": ?2', 1))
    assert sorted(r.polygon_id for r in geojson.read_polygons(spark, str(path), "id").collect()) == [0, 1, 3, 4]
    for name, content in (("none", {"type": "FeatureCollection", "features": []}), ("bare", features(1)[0]["geometry"])):
        (tmp_path / name).write_text(json.dumps(content))
        assert geojson.read_polygons(spark, str(tmp_path / name)).count() == int(name == "bare")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.75])
def test_similar_names_equal_all_pairs(spark, least):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randint(1, 9)))
    words, names = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)} | {"rudraprayag", "Uttarkashi"})
    words += ["rudarprayg", "uttarkaashi", ""]
    found = spelling.similar_names(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"), spark.createDataFrame([(n,) for n in names], "name string"), least)
    got = {(r.word, r.name): r.score for r in found.collect()}
    want = {}
    for w in words:
        for n in names:
            score = 1 - distance(w.lower(), n.lower()) / max(len(w), len(n))
            if w and score >= least:
                want[w, n] = score
    assert set(got) == set(want) and len(want) > 300 * (least < 0.7)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_queries_are_corrected(spark):
    places = spark.createDataFrame([("Almora", 1), ("Rishikesh", 2), ("Alpora", 0), ("Almora", 9)], "place string, position int")
    asked = {"Almra, India": "Almora, India", "almora": "almora", "Rishkesh": "Rishikesh", " Risikesh , Almra": " Rishikesh , Almra", "xyz": "xyz",
             "": "", ", India": ", India", "Alkora": "Alpora"}
    rows = [(i, q) for i, q in enumerate(asked)] * 2 + [(99, None)]
    out = spelling.correct_spelling(spark.createDataFrame(rows, "id int, q string"), "q", places).collect()
    assert len(out) == len(rows) and all(r.fixed == (asked[r.q] if r.q is not None else None) for r in out)
    with pytest.raises(ValueError):
        spelling.correct_spelling(spark.createDataFrame(rows, "id int, q string"), "q", places, 0.4)
