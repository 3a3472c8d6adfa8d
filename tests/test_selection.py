"""Selection in turn against a plain greedy, review batches with their manifests, and memberships of any size."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from cloudstrata.functions.hashing import membership_id
from cloudstrata.operators import batches, records, selection


def greedy(anchors, pools, alike, target):
    """One after another: the groups in the order of names each give the first of theirs that is like none of those taken, pass by pass."""
    taken, of = list(anchors), {}
    left = {g: list(keys) for g, keys in sorted(pools.items())}
    while any(left.values()) and len(taken) < target:
        for keys in left.values():
            picked = False
            while keys and not picked and len(taken) < target:
                key = keys.pop(0)
                twins = [t for t in taken if frozenset((t, key)) in alike]
                if twins:
                    of[key] = twins[0]
                else:
                    taken.append(key)
                    picked = True
    return taken, of


@pytest.mark.parametrize("seed", range(5))
def test_select_in_turn(spark, seed):
    r = random.Random(seed)
    pools = {f"g{k}": [f"g{k}c{j}" for j in range(r.randrange(7))] for k in range(r.randrange(1, 6))}
    anchors = [f"a{k}" for k in range(r.randrange(3))]
    everything = anchors + [c for keys in pools.values() for c in keys]
    alike = {frozenset(r.sample(everything, 2)) for _ in range(r.randrange(3 * len(everything)))} if len(everything) > 1 else set()
    pairs = [tuple(sorted(p, key=lambda _: r.random())) for p in alike]
    for target in (len(anchors), len(anchors) + 3, 100):
        chosen, aliases = selection.select_in_turn(
            spark.createDataFrame([(k, n) for n, k in enumerate(anchors)], "key string, place long"), spark.createDataFrame([(c, g, j) for g, keys in pools.items() for j, c in enumerate(keys)], "key string, group string, turn long"),
            spark.createDataFrame(pairs, "a string, b string"), target,
        )
        taken, of = greedy(anchors, pools, alike, target)
        assert [x["key"] for x in chosen.orderBy("place").collect()] == taken
        assert {x["key"]: x["of"] for x in aliases.collect()} == of


def components(spark, seed=1):
    """Members, components and the crop bounds of three crops of two sources, with overlapping and equal memberships."""
    r = random.Random(seed)
    members, rows = [], []
    for source in ("left", "right"):
        for c in range(3):
            for label in range(6):
                own = sorted(r.sample(range(40), r.randrange(3, 12))) if label != 3 or c == 0 else list(range(15, 21))
                members += [(source, f"crop{c}", label, row) for row in own]
                x = float(r.randrange(50) + 100 * c)
                rows.append((source, f"crop{c}", f"region{c % 2}", label, label == 0 and source == "left", len(own), float(r.randrange(5)), x, x + r.randrange(1, 9), 0.0, float(r.randrange(1, 4)), 0.0, float(r.randrange(1, 20))))
    box = ", ".join(f"{n}_{a} double" for a in "xyz" for n in ("min", "max"))
    return (
        spark.createDataFrame(rows, f"source string, crop string, region string, label int, is_parent boolean, point_count long, clearance double, {box}"), spark.createDataFrame(members, "source string, crop string, label int, row_id long"), rows, members
    )


def plain_batch(rows, members, target, minimum, edge):
    sets, name = {}, {}
    for source, crop, label, row in members:
        sets.setdefault((source, crop, label), set()).add(row)
    for key, own in sets.items():
        name[key] = "candidate_" + hashlib.sha256(key[0].encode() + b"".join(struct.pack("<q", v) for v in sorted(own))).hexdigest()[:24]
    hint = lambda s: "elongated" if s[2] >= 2.5 * max(s[1], 1e-12) else "thin" if s[1] >= 2.5 * max(s[0], 1e-12) else "compact"
    anchors, pools = [], {}
    for source, crop, _, label, parent, n, clearance, *b in rows:
        if parent:
            anchors.append((source, crop, label))
        elif n >= minimum and clearance > edge:
            pools.setdefault(crop, []).append(((-n, -clearance, source, label), hint(sorted(b[k + 1] - b[k] for k in (0, 2, 4))), (source, crop, label)))
    queues = {}
    for crop, own in pools.items():
        own.sort()
        hints = list(dict.fromkeys(h for _, h, _ in own))
        lists = {h: [k for _, g, k in own if g == h] for h in hints}
        queues[crop] = [k for turn in range(len(own)) for h in hints for k in lists[h][turn : turn + 1]]
    alike = {frozenset((a, b)) for a in sets for b in sets if a != b and a[0] == b[0] and len(sets[a] & sets[b]) >= 0.8 * min(len(sets[a]), len(sets[b]))}
    taken, of = greedy(sorted(anchors), queues, alike, target)
    return [name[k] for k in taken], {name[t]: sorted({name[k] for k, o in of.items() if o == t}) for t in set(of.values())}


@pytest.mark.parametrize("seed", [1, 2])
def test_prepare_batch(spark, tmp_path, seed):
    frame, membership, rows, members = components(spark, seed)
    batch = batches.prepare_batch(frame, membership, 9, 4, 0.5)
    got = batch.candidates.orderBy("place").collect()
    names, aliases = plain_batch(rows, members, 9, 4, 0.5)
    assert [c["candidate_id"] for c in got] == names
    assert {c["candidate_id"]: c["aliases"] for c in got if c["aliases"]} == aliases
    assert batch.groups.select("group_id").distinct().count() == len({c["group"] for c in got})
    root = f"file://{tmp_path}/batches"
    manifest = batches.save_batch(batch, root)
    assert manifest["counts"] == {"candidates": len(names), "parents": 3, "additions": len(names) - 3, "regions": 2, "groups": len({c["group"] for c in got})}
    folder = manifest["batch_path"].rsplit("/", 1)[0]
    for path in (manifest["batch_path"], folder, f"{root}/active_batch.json"):
        assert batches.load_batch(spark, path) == manifest
    later = batches.save_batch(batch, root)
    assert batches.load_batch(spark, f"{root}/active_batch.json") == later and batches.load_batch(spark, folder) == manifest
    crop = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") * 2.0).alias("x"))
    record, points = batches.load_candidate(spark, folder, names[-1], crop)
    assert record["place"] == len(names) - 1 and points.count() == 40 and points.filter("member").count() == record["point_count"]
    assert batches.load_candidate(spark, folder, names[-1], crop, context=False)[1].count() == record["point_count"]
    with pytest.raises(ValueError, match="one candidate"):
        batches.load_candidate(spark, folder, "other", crop)
    with pytest.raises(ValueError, match="crop"):
        batches.load_candidate(spark, folder, names[-1], crop.filter("row_id < 2"))
    path = tmp_path / "batches" / folder.rsplit("/", 1)[1] / "batch.json"
    for change, message in ((lambda m: m["candidates"].append(m["candidates"][0]), "more than once"), (lambda m: m.update(schema_version=0), "version"), (lambda m: m["candidates"][-1].update(membership_fingerprint="x"), "as it was saved")):
        other = json.loads(json.dumps(manifest))
        change(other)
        path.write_text(json.dumps(other))
        (path.parent / ".batch.json.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError, match=message):
            batches.load_candidate(spark, folder, names[-1], crop)


def test_interleaved(spark):
    r = random.Random(3)
    rows = [(k, r.choice(["a", "b", None]), r.choice("xyz"), r.randrange(5)) for k in range(200)]
    got = {x["id"]: x["turn"] for x in records.interleaved(spark.createDataFrame(rows, "id long, g string, h string, n int"), "g", "h", [F.desc("n"), "id"]).collect()}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[3], x[0]))
        hints = list(dict.fromkeys(x[2] for x in own))
        lists = {h: [x[0] for x in own if x[2] == h] for h in hints}
        want = [k for turn in range(len(own)) for h in hints for k in lists[h][turn : turn + 1]]
        assert [got[k] for k in want] == list(range(1, len(own) + 1))


def test_membership_ids(spark):
    """Groups that span batches, with null keys, repeated rows, negative row numbers, and one of a million rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(g, h, v) for g, h in ((None, 1), (1, None), (1, 1), (2, 1)) for v in random.Random(str((g, h))).choices(range(-50, 50), k=60)]
        frame = spark.createDataFrame(rows, "g long, h long, row_id long").repartition(3)
        got = {(x["g"], x["h"]): (x["candidate_id"], x["point_count"]) for x in membership_id(frame, ["g", "h"], F.lit("src")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 4
    for (g, h), found in got.items():
        own = sorted({v for a, b, v in rows if (a, b) == (g, h)})
        assert found == ("candidate_" + hashlib.sha256(b"src" + b"".join(struct.pack("<q", v) for v in own)).hexdigest()[:24], len(own))
    import numpy as np

    large = membership_id(spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").alias("row_id")), ["g"], F.lit("s")).first()
    assert large["candidate_id"] == "candidate_" + hashlib.sha256(b"s" + np.arange(1_000_000, dtype="<i8").tobytes()).hexdigest()[:24] and large["point_count"] == 1_000_000
    assert membership_id(spark.createDataFrame([], "g long, row_id long"), ["g"], F.lit("s")).count() == 0


def test_names(spark):
    batch = spark.createDataFrame([("0123456789abcdef_00012", ["old", "both"]), ("candidate_" + "a" * 24, ["both"]), ("c", None)], "candidate_id string, legacy_ids array<string>")
    names = spark.createDataFrame([("old",), ("both",), ("c",), ("nobody",)], "name string")
    assert {(r["name"], r["candidate_id"]) for r in batches.resolved(batch, names).collect()} == {("old", "0123456789abcdef_00012"), ("c", "c")}
    assert batches.known_candidate(batch, "0123456789abcdef_00012") and batches.known_candidate(batch, "candidate_" + "a" * 24)
    for bad in ("c", "0123456789abcdef_12", "0123456789abcdef_00013", "../x"):
        with pytest.raises(ValueError):
            batches.known_candidate(batch, bad)


def test_context_summary(spark):
    points = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    members = points.filter("x between 4 and 5 and y between 4 and 5")
    inner, outer = (batches.context_summary(points, members, p).first() for p in (2.0, 5.0))
    assert (inner["points"], inner["members"], inner["truncated"]) == (36, 4, False) and outer["truncated"] and outer["low_x"] == -1.0 and inner["note"] != outer["note"]
    assert batches.context_summary(points, members, 2.0, (3.0, 9.0, 0.0, 9.0)).first()["truncated"]
