"""Edge rows that the driver tables do not have."""

import random

import pytest
from pyspark.sql import functions as F

from basinframe.functions import exprs as X
from basinframe.operators import campaign, catalogue, lattice, matching, registry, samples, text

NAN, INF = float("nan"), float("inf")


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_sentinels_finite_and_known(spark):
    d = rows(spark, [(1.0,), (X.FLOAT_MAX,), (-X.FLOAT_MAX * (1 - 1e-13),), (NAN,), (INF,), (None,), (1e16,)], "v double")
    got = d.select(X.is_sentinel(F.col("v")), X.finite(F.col("v")), X.plausible(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [
        (False, True, True), (True, True, False), (True, True, False), (False, False, False), (False, False, False),
        (False, False, False), (False, True, False),
    ]
    k = rows(spark, [("m",), (" Unknown ",), ("",), (None,), ("unresolved: x",), ("N/A",), ("note",), ("none",), ("unknown zone",), ("Not_Decoded",), ("not_decoded_x",), ("not established",), ("unresolved x",)], "t string")
    assert [r[0] for r in k.select(X.known(F.col("t"))).collect()] == [True, False, False, False, False, True, True, True, True, False, False, False, True]


def test_numbers_from_text(spark):
    d = rows(spark, [("1.5",), ("x",), ("NaN",), ("Infinity",), (None,), (" 2 ",)], "t string")
    assert [r[0] for r in d.select(X.number_or_null(F.col("t"))).collect()] == [1.5, None, None, None, None, 2.0]
    v = rows(spark, [(3.0000001,), (3.1,), (NAN,), (1e30,), (-2.0,)], "v double")
    assert [r[0] for r in v.select(X.exact_integer(F.col("v"))).collect()] == [3, None, None, None, -2]


def test_histogram_edges(spark):
    d = rows(spark, [("a", 0.0), ("a", 10.0), ("a", 5.0), ("b", 7.0), ("b", 7.0), ("c", None)], "k string, v double")
    got = {(r.k, r.bin): r.n for r in samples.histogram(d, ["k"], F.col("v"), 4).collect() if r.n}
    assert got == {("a", 0): 1, ("a", 2): 1, ("a", 3): 1, ("b", 2): 2}


def test_sequence_quality(spark):
    data = [("up", 1, 1.0), ("up", 2, 2.0), ("up", 3, 2.0), ("down", 1, 3.0), ("down", 2, 1.0), ("mixed", 1, 1.0), ("mixed", 2, 5.0), ("mixed", 3, 2.0), ("one", 1, -1.0), ("nan", 1, NAN)]
    got = {r.w: r for r in samples.sequence_quality(rows(spark, data, "w string, s int, d double"), ["w"], ["s"], "d").collect()}
    assert got["up"].monotonic and got["up"].repeated == 1 and not got["up"].too_sparse
    assert got["down"].monotonic and got["down"].too_sparse
    assert not got["mixed"].monotonic
    assert got["one"].monotonic and got["one"].negative == 1
    assert got["nan"].nonfinite == 1


def test_runs_with_nulls(spark):
    data = [(k, v) for k, v in enumerate([None, None, True, True, False, None])]
    got = samples.runs(rows(spark, [("g", *x) for x in data], "g string, i int, v boolean"), ["g"], ["i"], "v", "i").collect()
    assert sorted((r.start, r.length, r.v) for r in got) == [(0, 2, None), (2, 2, True), (4, 1, False), (5, 1, None)]


def test_segments_decimation_and_even_picks(spark):
    d = rows(spark, [("l", k, k in (2, 5)) for k in range(8)], "l string, k int, m boolean")
    assert sorted(r.vertices for r in samples.segments(d, ["l"], ["k"], "m").collect()) == [2, 2, 2]
    assert sorted(r.k for r in samples.decimated(d, ["l"], ["k"], 3).collect()) == [0, 3, 6, 7]
    assert sorted(r.k for r in samples.evenly(d, ["l"], ["k"], 3).collect()) == [0, 3, 7]
    assert sorted(r.k for r in samples.evenly(d, ["l"], ["k"], 50).collect()) == list(range(8))
    assert sorted(r.k for r in samples.evenly(d.limit(1), ["l"], ["k"], 3).collect()) == [0]


def test_envelope_flags_two_axes(spark):
    data = [("t", k, float(k % 3), float(k % 3)) for k in range(10)] + [("t", 10, 99.0, 1.0), ("t", 11, 500.0, -500.0)]
    got = {r.k: r.plausible for r in samples.trailing_envelope(rows(spark, data, "t string, k int, x double, y double"), ["t"], ["k"], ["x", "y"]).collect()}
    assert got[10] and not got[11] and got[0]


def test_lattice(spark):
    nodes = rows(spark, [(i, j, float(i + j), not (i == 0 and j == 0)) for i in range(3) for j in range(3)], "i int, j int, raw double, defined boolean")
    cells = {(r.i, r.j): (r.valid, r["mean"]) for r in lattice.cells(nodes).collect()}
    assert cells == {(0, 0): (False, None), (0, 1): (True, 2.0), (1, 0): (True, 2.0), (1, 1): (True, 3.0)}
    moved = {(r.i, r.j): (r.x, r.y) for r in lattice.coordinates(nodes, (0.0, 0.0), (1.0, 1.0), 90.0).collect()}
    assert moved[(1, 0)] == pytest.approx((0.0, 1.0)) and moved[(0, 1)] == pytest.approx((-1.0, 0.0))
    t = rows(spark, [([0.5, 1.0, NAN, None, 0.0],)], "s array<double>")
    assert t.select(lattice.amplitude_mask(F.col("s"), 0.0, 1.0)).first()[0] == [0.5, None, None, None, None]


def test_latest_breaks_ties_and_gaps_are_seen(spark):
    d = rows(spark, [(1, 5, 10), (1, 5, 11), (1, 4, 99)], "k int, version int, pk int")
    assert [tuple(r) for r in registry.latest(d, ["k"], ["version", "pk"]).collect()] == [(1, 5, 11)]
    parts = rows(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 2, "c"), (3, 0, "a"), (3, 0, "b"), (4, 1, "z")], "k int, o int, t string")
    got = {r.k: (r.t, r.status) for r in registry.reassembled(parts, "k", "o", "t").collect()}
    assert got == {1: ("ab", "complete"), 2: (None, "gap"), 3: (None, "gap"), 4: (None, "gap")}


def test_diff_upsert_and_duplicates(spark):
    a, b = rows(spark, [(1, "x"), (2, None), (3, "z")], "k int, v string"), rows(spark, [(2, None), (3, "y"), (4, "n")], "k int, v string")
    assert {r.k: r.status for r in registry.keyed_diff(a, b, "k", "v").collect()} == {1: "removed", 2: "unchanged", 3: "changed", 4: "added"}
    assert sorted((r.k, r.v) for r in registry.upsert(a, b, "k").collect() if r.v) == [(1, "x"), (3, "y"), (4, "n")]
    files = rows(spark, [(1, 5, "h"), (2, 5, "h"), (3, 5, "other"), (4, 6, "h")], "p int, b int, h string")
    assert {r.p: (r.survivor, r.copies) for r in registry.content_groups(files, "p", ["b"], "h").collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}


def test_nearest_in_band(spark):
    left = rows(spark, [(1, "k", 100), (2, "k", 1000), (3, "k", 228)], "id int, k string, p int")
    right = rows(spark, [("k", 90, "a"), ("k", 110, "b"), ("k", 229, "c"), ("k", 356, "c")], "k string, p int, name string")
    got = {r.id: (r.name, r.gap, r.names) for r in matching.nearest_in_band(left, right, "k", "p", "name", 128, "id").collect()}
    assert got == {1: (None, 10, 2), 2: (None, None, 0), 3: ("c", 1, 1)}


def test_nearest_in_band_against_all_pairs(spark):
    """Ties between names on both sides, shared and not, repeated ids, nulls and a crowd at one position, of which no pairs are made."""
    draw = random.Random(7)
    left = [(draw.choice([None, *range(60)]), draw.choice(["k", "z", None]), draw.choice([None, *range(40)])) for _ in range(200)] + [(1000 + k, "c", k % 2) for k in range(400)]
    right = [(draw.choice(["k", "z", None]), draw.choice([None, *range(0, 40, 3)]), draw.choice(["a", "b", "c", None])) for _ in range(60)] + [("c", 2, draw.choice("ab")) for _ in range(400)]
    want = []
    for i, _, _ in left:
        gaps = [(abs(p - q), n) for j, k, p in left if i is not None and i == j and None not in (k, p) for m, q, n in right if m == k and q is not None and abs(p - q) <= 3]
        names = {n for g, n in gaps if g == min(gaps, key=lambda x: x[0])[0]}
        want.append((i, next(iter(names)) if len(names) == 1 else None, min(gaps, key=lambda x: x[0])[0] if gaps else None, len(names)))
    made = matching.nearest_in_band(rows(spark, left, "id int, k string, p int").repartition(4), rows(spark, right, "k string, p int, name string"), "k", "p", "name", 3, "id")
    assert sorted(map(tuple, made.select("id", "name", "gap", "names").collect()), key=str) == sorted(want, key=str)


def test_unique_match_and_roots(spark):
    left = rows(spark, [(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "d"), (6, None)], "id int, k string")
    right = rows(spark, [(10, "a"), (11, "b"), (12, "c"), (13, "c")], "rid int, k string")
    got = {r.id: (r.status, r.match) for r in matching.unique_match(left, right, "k", "id", "rid").collect()}
    assert got == {1: ("matched", 10), 2: ("ambiguous_left", None), 3: ("ambiguous_left", None), 4: ("ambiguous_right", None), 5: ("unresolved", None), 6: ("no_key", None)}
    p = rows(spark, [("a/b/c",), ("x",), ("a/bc",)], "p string")
    r = rows(spark, [("a",), ("a/b",)], "r string")
    assert {x.p: x.r for x in matching.longest_root(p, r, "p", "r").collect()} == {"a/b/c": "a/b", "x": None, "a/bc": "a"}


def test_as_of_keeps_ties_and_missing(spark):
    left = rows(spark, [(1, "k", 10), (2, "k", 5), (3, "z", 1)], "id int, k string, t int")
    right = rows(spark, [("k", 10, "now"), ("k", 7, "old")], "k string, t int, v string")
    assert {r.id: r.v for r in matching.latest_before(left, right, "k", "t", "v").collect()} == {1: "now", 2: None, 3: None}


def test_graph_cycles_and_dangling_parents(spark):
    e = rows(spark, [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("d", "gone"), ("z", "x")], "c string, p string")
    levels = {r.c: r.level for r in catalogue.levels(e, "c", "p").collect()}
    assert levels == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "d": None, "z": None}
    walks = {r.node: (r.path, r.status) for r in catalogue.ancestry(e, "c", "p").collect()}
    assert walks["c"] == ("a/b/c", "rooted") and walks["d"][1] == "dangling"
    assert {walks[k][1] for k in "xyz"} == {"cycle"}


def test_levels_wait_for_all_needs(spark):
    e = rows(spark, [("a", None), ("b", "a"), ("m", "a"), ("m", "b")], "c string, p string")
    assert {r.c: r.level for r in catalogue.levels(e, "c", "p").collect()} == {"a": 0, "b": 1, "m": 2}


def test_resolution_of_evidence(spark):
    o = rows(spark, [("e", "1"), ("e", "1.0"), ("f", "m"), ("f", "m"), ("f", "unknown"), ("g", None)], "k string, v string")
    got = {r.k: (r.status, r.value) for r in catalogue.resolved(o, ["k"], "v").collect()}
    assert got == {"e": ("conflict", None), "f": ("recorded", "m"), "g": ("unresolved", None)}


def test_wave_is_greedy_within_budget(spark):
    c = rows(spark, [(1, "g", 50, ["a", "b", "c"]), (2, "h", 10, ["a"]), (3, "h", 10, ["d", "e"]), (4, "i", 100, ["z"] * 3)], "id long, group string, bytes long, features array<string>")
    assert [(r.id, r.gained) for r in catalogue.chosen_wave(c, 70).orderBy("turn").collect()] == [(1, 3), (3, 2)]
    weights = rows(spark, [("z", 9.0), ("a", 0.0)], "feature string, weight double")
    assert [(r.id, r.gained) for r in catalogue.chosen_wave(c, 150, weights).orderBy("turn").collect()] == [(4, 9.0), (3, 2.0)]
    assert catalogue.chosen_wave(c.limit(0), 70).collect() == [] and catalogue.chosen_wave(c, 5).collect() == []


def test_deep_graphs_have_all_their_levels(spark):
    chain = rows(spark, [(k, k - 1 if k else None) for k in range(40)] + [(90, 91), (91, 90), (92, 39), (92, 7)], "c long, p long")
    found = {r.c: r.level for r in catalogue.levels(chain, "c", "p").collect()}
    assert found == {**{k: k for k in range(40)}, 90: None, 91: None, 92: 40}


def test_matches_are_counted_as_runs(spark):
    t = rows(spark, [(1, "b1 a2 b1 a2 a2 c"), (2, "none"), (3, None), (4, "")], "id int, t string")
    got = {(r.id, r.found, r.occurrences, r.first) for r in text.pattern_scan(t, "id", "t", "[a-z][0-9]").collect()}
    assert got == {(1, "b1", 2, 1), (1, "a2", 3, 4)}


def test_reasons_and_scrubbed_texts(spark):
    said = r"at 'C:\a b\c.las', \\srv\x 0x1f v2 17 00000000-AAAA-2222-3333-44444444abcd  me@x.org token=ab https://x.org/1"
    t = rows(spark, [(said,), (None,), ("",)], "t string")
    reasons = [r[0] for r in t.select(X.normalised_reason(F.col("t"))).collect()]
    assert reasons == ["at <path>, <path> <hex> v2 <n> <object> me@x.org token=ab http<path>", None, ""]
    one, two = (t.select(X.scrubbed(F.col("t"), s)).first()[0] for s in ("s", "t"))
    assert one != two and "token=[redacted]" in one and not any(x in one for x in ("AAAA", "me@x", "srv", "x.org"))


def test_retries(spark):
    data = [("a", k, f) for k, f in enumerate([True, True, False, False, True, False, True])]
    got = campaign.retry_pairs(rows(spark, data, "w string, k int, f boolean"), ["w"], ["k"], F.col("f")).collect()
    assert sorted((r.failures, r.status) for r in got) == [(1, "open"), (1, "recovered"), (2, "recovered")]


def test_text_profiles_and_signatures(spark):
    t = rows(spark, [(1, "a,b\nc,d\n\n"), (2, "x"), (3, ""), (4, "3\nkey\n v \nk2\nw\nodd")], "id int, t string")
    got = {r.id: (r.lines, r.blank, r.delimiter) for r in text.profile(t, "id", "t").collect()}
    assert got[1] == (4, 2, "comma") and got[2] == (1, 0, "none") and got[3] == (1, 1, "none")
    assert [(r.key, r.value) for r in text.property_pairs(t.where("id = 4"), "id", "t").collect()] == [("key", "v"), ("k2", "w")]
    b = rows(spark, [(bytearray(b"SQLite format 3\0"),), (bytearray(b"<?xml v"),), (bytearray(b"VBS\0x"),), (bytearray(b""),), (None,), (bytearray(b"zz"),)], "c binary")
    assert [r[0] for r in b.select(X.format_signature(F.col("c"))).collect()] == ["SQLITE", "XML", "ZGY", "EMPTY", "EMPTY", "BINARY"]
    m = rows(spark, [(bytearray([0b00000101, 0b1]), n) for n in (0, 1, 2, 8)], "m binary, n int")
    assert [r[0] for r in m.select(X.bit(F.col("m"), F.col("n"))).collect()] == [True, False, True, True]


def test_withdrawal_gate(spark):
    from basinframe.streaming import events

    d = rows(spark, [("a",), ("b",)], "o string")
    assert [r.o for r in events.withdraw_failed(d, rows(spark, [("a",)], "o string"), "o").collect()] == ["b"]
    assert events.withdraw_failed(d, rows(spark, [("a",), (None,)], "o string"), "o").collect() == []
    assert events.withdraw_failed(d, rows(spark, [], "o string"), "o").count() == 2


def test_located_matches_keep_their_surroundings(spark):
    t = rows(spark, [(1, "xx a1 yy a1zb2"), (2, "none"), (3, None), (4, "a1")], "id int, t string")
    got = sorted((r.id, r.offset, r.match, r.before, r.after) for r in text.located_matches(t, "id", "t", "([a-z])([0-9])", 3).collect())
    assert got == [(1, 3, "a1", "xx ", " yy"), (1, 9, "a1", "yy ", "z"), (1, 12, "b2", "z", ""), (4, 0, "a1", "", "")]
    found = text.registry_entries(text.located_matches(t, "id", "t", "([a-z])([0-9])", 3), "id", "([a-z])([0-9])", {"kind": 1}, 1).collect()
    assert sorted((r.id, r.kind, r.occurrences, r.first, r.context) for r in found) == [(1, "a", 2, 3, "xx a1 yy"), (4, "a", 1, 0, "a1")]


def _catalogue(spark):
    kinds = ["well", "well_log", "surface_geometry", "folder"]
    entities = rows(spark, [(f"e{k}", c, "decoded", None) for k, c in enumerate(kinds)], "entity_key string, category string, source_status string, materialization_status string")
    sha = "0" * 64
    schema = "artifact_key int, entity_key string, role string, index_section string, original_status string, numerical_qc string, recorded_sha256 string, current_sha256 string, expected_bytes long, current_bytes long, retention string"
    made = [(k, f"e{k}", r, "files", "exported", "exact_readback", sha, sha, 5, 5, None) for k, r in enumerate(["data", "data", "geometry_values"])]
    artifacts = rows(spark, made, schema)
    links = rows(spark, [("e1", "e0", "source_well", "exact_id_reference")], "source_key string, target_key string, relation string, status string")
    grid = '{"dimensions":[2,3],"origin_xy":[0,0],"i_basis":[1,0],"j_basis":[0,1],"index_order":"i_major_j_minor"}'
    own = {
        "e0": {"crs_status": "verified", "depth_unit": "m", "horizontal_unit": "m", "crs": "c", "vertical_domain": "depth", "vertical_unit": "m", "vertical_reference": "msl", "well_identity": "w",
               "head_semantics": '{"xyz_roles":"x","vertical_reference":"msl","source_locator":"l"}'},
        "e1": {"crs_status": "verified", "depth_unit": "m", "unit": "API", "unit_status": "validated_metric_profile", "md_unit": "m", "md_reference": "kb", "log_kind": "continuous_scalar",
               "index_kind": "measured_depth", "sampling_kind": "point_samples", "index_shape": "scalar_1d", "value_shape": "scalar_1d", "null_semantics": '{"representation":"nan","source_rule":"r"}'},
        "e2": {"crs_status": "verified", "depth_unit": "m", "horizontal_unit": "m", "unit": "m", "unit_status": "validated_metric_profile", "crs": "c", "vertical_domain": "time", "vertical_unit": "ms",
               "time_convention": "TWT", "surface_role": "horizon_geometry", "grid_registration": grid},
    }
    evidence = rows(spark, [(k, f, v) for k, fs in own.items() for f, v in fs.items()], "entity_key string, field string, raw_value string")
    return [entities, artifacts, links, evidence]


def test_a_whole_catalogue_is_assessed_and_mapped(spark):
    from basinframe.operators import contract

    tables = _catalogue(spark)
    found = {r.entity_key: r.codes for r in contract.assessed(contract.facts_of(*tables)).collect()}
    assert found == {"e0": "", "e1": "", "e2": "", "e3": "NO_AVAILABLE_ACCEPTED_FULL_PAYLOAD"}
    late = contract.assessed(contract.facts_of(*tables), contract.Delivery(committed=False, revision_verified=False)).where("entity_key = 'e0'").first()
    assert late.codes == "PUBLICATION_NOT_FINAL,SOURCE_REVISION_IDENTITY_UNRESOLVED" and late.n_codes == 2
    schema = "entity_key string, target_version string, target_api_version string, target_object_id string, well_target_key string, well_target_id string, well_target_state string, reference_volume_key string, assertions map<string,string>, survey map<string,string>, derived boolean"
    survey = {"target_id": "s", "crs": "c", "horizontal_unit": "m", "vertical_domain": "time", "vertical_unit": "ms", "time_convention": "TWT"}
    decisions = [("e0", "1", None, "o", None, None, None, None, None, None, None), ("e1", "1", None, "o", "e0", "t", "planned", None, {"md_unit": "m"}, None, None), ("e2", "1", None, "o", None, None, None, None, None, survey, None)]

    def states(receiver, given):
        return {r.entity_key: (r.receiving_state, r.codes) for r in contract.mapped(contract.facts_of(*tables), rows(spark, given, schema), receiver).collect()}

    files = contract.Receiver("1", None, ("well", "well_log", "surface_geometry"))
    got = states(files, decisions)
    assert got["e0"] == got["e1"] == ("qualified_for_planned_mapping", "")
    assert got["e2"] == ("blocked_relationship", "REFERENCE_VOLUME_BINDING_UNRESOLVED") and got["e3"][0] == "blocked_missing_payload"
    strict = contract.Receiver("1", None, ("well_log", "surface_geometry"), existing_wells_only=True, needs_lattice=True)
    got = states(strict, decisions)
    assert got["e0"] == ("unsupported_target_mapping", "TARGET_MAPPING_UNSUPPORTED") and got["e1"] == ("unsupported_target_mapping", "TARGET_DEPENDENCY_CREATION_UNSUPPORTED")
    assert got["e2"] == ("blocked_metadata", "SURVEY_LATTICE_MISMATCH")
    derived = [(*decisions[2][:10], True)]
    assert states(strict, derived)["e2"] == ("requires_derived_mapping", "SURVEY_LATTICE_MISMATCH")
    wrong = [("e1", "2", None, None, "e3", "t", "planned", None, {"md_unit": "ft", "log_kind": "other"}, None, None)]
    assert states(files, wrong)["e1"][1].split(",") == ["LOG_KIND_UNSUPPORTED", "SOURCE_DECISION_CONFLICT", "TARGET_OBJECT_DECISION_REQUIRED", "TARGET_PROFILE_DECISION_REQUIRED", "WELL_TARGET_BINDING_UNRESOLVED"]


def test_receivers_ask_for_whole_tracks_valid_lattices_and_registered_nodes(spark):
    import json

    from basinframe.operators import contract

    grid = {"dimensions": [2, 3], "origin_xy": [0, 0.5], "i_basis": [1, 0], "j_basis": [0, 1e1], "index_order": "i_major_j_minor"}
    track = {"station_order": "stored", "md_source": "stored_measured_depth", "vertical_reference": "msl", "full_track": True}
    nodes = {"parent_entity_key": "g", "method": "m", "count": 6, "validated": True}
    cases = {
        "t0": ("trajectory", {"track_semantics": track}, None), "t1": ("trajectory", {"track_semantics": track | {"full_track": False}}, "TRACK_SEMANTICS_UNRESOLVED"),
        "t2": ("trajectory", {"track_semantics": track | {"full_track": "true"}}, "TRACK_SEMANTICS_UNRESOLVED"), "t3": ("trajectory", {"track_semantics": track | {"md_source": "derived"}}, "TRACK_SEMANTICS_UNRESOLVED"),
        "g": ("surface_geometry", {"grid_registration": grid}, None), "p0": ("surface_property", {"grid_registration": grid, "node_registration": nodes}, None),
    }
    for k, change in enumerate(({"dimensions": [2, 0]}, {"dimensions": [2, 3, 4]}, {"dimensions": ["2", 3]}, {"dimensions": [2.5, 3]}, {"origin_xy": [0]}, {"origin_xy": [0, "1"]}, {"j_basis": [2, 0]}, {"i_basis": None}, {"index_order": "other"})):
        cases[f"g{k}"] = ("surface_geometry", {"grid_registration": grid | change}, "GRID_REGISTRATION_UNRESOLVED")
    for k, change in enumerate(({"count": 5}, {"count": "6"}, {"count": 6.0}, {"validated": "true"}, {"validated": False}, {"parent_entity_key": "g0"}, {"method": "unknown"})):
        cases[f"p{k + 1}"] = ("surface_property", {"grid_registration": grid, "node_registration": nodes | change}, "NODE_REGISTRATION_UNVERIFIED")
    cases["p8"] = ("surface_property", {"grid_registration": grid}, "NODE_REGISTRATION_UNVERIFIED")
    entities = rows(spark, [(k, c[0], "decoded", None) for k, c in cases.items()], "entity_key string, category string, source_status string, materialization_status string")
    artifact = "artifact_key int, entity_key string, role string, index_section string, original_status string, numerical_qc string, recorded_sha256 string, current_sha256 string, expected_bytes long, current_bytes long, retention string"
    links = [(k, "g", "native_parent", "exact_id_reference") for k in cases if k[0] == "p"]
    evidence = [(k, f, json.dumps(v)) for k, c in cases.items() for f, v in c[1].items()]
    facts = contract.facts_of(entities, rows(spark, [], artifact), rows(spark, links, "source_key string, target_key string, relation string, status string"), rows(spark, evidence, "entity_key string, field string, raw_value string"))
    schema = "entity_key string, target_version string, target_api_version string, target_object_id string, well_target_key string, well_target_id string, well_target_state string, reference_volume_key string, assertions map<string,string>, survey map<string,string>, derived boolean"
    receiver = contract.Receiver("1", None, ("trajectory", "surface_geometry", "surface_property"))
    got = {r.entity_key: set(r.codes.split(",")) for r in contract.mapped(facts, rows(spark, [], schema), receiver).collect()}
    asked = {"TRACK_SEMANTICS_UNRESOLVED", "GRID_REGISTRATION_UNRESOLVED", "NODE_REGISTRATION_UNVERIFIED"}
    assert {k: got[k] & asked for k in cases} == {k: {c[2]} if c[2] else set() for k, c in cases.items()}


def test_scrubbing_evaluates_each_text_once(spark):
    assert str(X.scrubbed(F.col("t"), "s")).count("regexp_extract_all") == 4  # one for each kind, not twice as many for each further one
    d = rows(spark, [(None,), ("",), ("no match",), ("a@b.com x@y.org",)], "t string")
    got = [r[0] for r in d.select(X.scrubbed(F.col("t"), "s")).collect()]
    assert got[:3] == [None, "", "no match"] and len(set(got[3].split())) == 2 and "@" not in got[3]
