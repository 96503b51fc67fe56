"""Features of files read in parts against a parse of the whole file."""

import json
import random

import pytest

from slidemill.sources import annotations


def whole(path):
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    rows = []
    for i, f in enumerate(data["features"] if isinstance(data, dict) else data):
        g = f.get("geometry") or None
        v = annotations.vertices_of(g.get("coordinates")) if g else []
        rows.append((i, json.dumps(f.get("properties") or {}, sort_keys=True), json.dumps(g) if g else None, v))
    return rows


def found(spark, path, size):
    rows = annotations.geojson_features(spark, str(path), size).collect()
    return sorted((r.fid, r.properties, r.geometry, [(v.vx, v.vy) for v in r.vertices]) for r in rows)


def feature(rng, i):
    x, y = rng.randrange(1000), rng.randrange(1000)
    shape = rng.choice([None, {"type": "Point", "coordinates": [x, y]}, {"type": "Polygon", "coordinates": [[[x, y], [x + 3, y], [x + 3, y + 2, 7], [x, y]]]}])
    text = rng.choice(['plain', 'a "quoted" } word', 'back\\slash\\', '\\"', '{"features": [{', 'é{ü]ß', "", "\\\\"])
    return {"type": "Feature", "id": i, "properties": rng.choice([None, {"name": text, "k": {"a": [1, {"b": "}"}]}}, {"features": [{"x": 1}]}]), "geometry": shape}


FILES = {
    "collection": lambda fs: json.dumps({"type": "FeatureCollection", "features": fs}),
    "before and after": lambda fs: json.dumps({"other": [{"features": [{"n": 1}]}, {"a": 2}], "features": fs, "tail": [{"b": 1}, {"c": 2}], "bbox": [1, 2]}, indent=1),
    "bare": lambda fs: " \n" + json.dumps(fs, ensure_ascii=False),
    "spread": lambda fs: json.dumps({"name": 'the "features": [ of {', "features": fs}, indent=3, ensure_ascii=False).replace('"features": [', '"features"  :\n [ '),
}


@pytest.mark.parametrize("kind", FILES)
@pytest.mark.parametrize("size", [29, 400, 1_000_000])
def test_parts(spark, tmp_path, kind, size):
    rng = random.Random(size)
    at = tmp_path / "f.json"
    at.write_text(FILES[kind]([feature(rng, i) for i in range(9 if size < 100 else 120)]), encoding="utf-8")
    assert found(spark, at, size) == whole(at)


def test_none_and_broken(spark, tmp_path):
    for name, text in (("empty", '{"features": []}'), ("list", "[]")):
        (tmp_path / name).write_text(text)
        assert found(spark, tmp_path / name, 8) == []
    for name, text in (("no", '{"type": "x", "other": [{"a": 1}]}'), ("cut", '{"features": [{"properties": {"a": 1'), ("open", '[{"a": "b')):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="no features|ends within"):
            found(spark, tmp_path / name, 8)


def test_many_parts_of_many_files(spark, tmp_path):
    rng = random.Random(9)
    paths = []
    for k in range(3):
        paths.append(str(tmp_path / f"{k}.json"))
        with open(paths[-1], "w") as f:
            f.write(json.dumps({"features": [feature(rng, i) for i in range(2000 * k)]}))
    rows = annotations.geojson_features(spark, paths, 20_000).collect()
    for k, p in enumerate(paths):
        assert sorted(r.fid for r in rows if r.path.endswith(f"/{k}.json")) == list(range(2000 * k))
        assert {r.fid: r.properties for r in rows if r.path.endswith(f"/{k}.json")} == {i: props for i, props, _, _ in whole(p)}
