"""Each departure of a well subject from its profile, packed, decoded and matched."""

import uuid

from basinframe.operators import wells as W
from basinframe.sources import containers as C
from basinframe.sources import packing as K
from basinframe.sources.scratch import settle

TAG, PROVIDER, OTHER = (str(uuid.UUID(int=n << 64 | 77)) for n in (1, 2, 3))
XY = [487300.91, 2847959.79]
VERSION = list(W.VERSION)


def level(name=W.LEVEL, offset=303.206, fields=W.LEVEL_FIELDS):
    values = {"name": "KB", "offset": offset, "description": " Kelly bushing"}
    return K.element(name, *(K.scalar(f, values[f]) for f in fields))


def subject(drop=(), extra=(), version=VERSION, namespace=W.NAMESPACE, **changes):
    parts = {
        W.TAG: K.scalar(W.TAG, TAG), W.NAME: K.scalar(W.NAME, "DMS-1"), W.UWI: K.scalar(W.UWI, "Declared"), W.PROVIDER: K.scalar(W.PROVIDER, uuid.UUID(PROVIDER)),
        W.HEAD: K.element(W.HEAD, K.array("double", XY)), W.LEVEL: level(), W.LEVELS: K.element(W.LEVELS, level(W.ITEM), Size=1), W.CONVERGENCE: K.scalar(W.CONVERGENCE, -0.0009),
    } | changes
    return K.element(W.SUBJECT, *(v for k, v in parts.items() if k not in drop), *extra, namespace=namespace, Version=version)


CASES = {
    "good": (subject(), "recorded", []),
    "profile": (subject(version=[34, *VERSION[1:]]), "rejected: profile", None),
    "text_profile": (subject(version=str(VERSION)), "rejected: profile", None),
    "space": (subject(namespace="other"), "rejected: profile", None),
    "uuid": (subject(**{W.TAG: K.scalar(W.TAG, "not one")}), "rejected: object id", None),
    "zero_uuid": (subject(**{W.TAG: K.scalar(W.TAG, uuid.UUID(int=0))}), "rejected: object id", None),
    "upper_uuid": (subject(**{W.TAG: K.scalar(W.TAG, "ABCDEF00-0000-4000-8000-000000000001")}), "rejected: object id", None),
    "twice": (subject(extra=[K.scalar(W.TAG, OTHER)]), "rejected: object id", None),
    "vector": (subject(**{W.HEAD: K.element(W.HEAD, K.array("double", [1.0, 2.0, 3.0]))}), "rejected: head", None),
    "nonfinite": (subject(**{W.HEAD: K.element(W.HEAD, K.array("double", [float("nan"), 2.0]))}), "rejected: head", None),
    "far": (subject(**{W.HEAD: K.element(W.HEAD, K.array("double", [2e15, 2.0]))}), "rejected: head", None),
    "whole_numbers": (subject(**{W.HEAD: K.element(W.HEAD, K.array("double", [1, 2], "<i4"))}), "rejected: head", None),
    "no_head": (subject(drop=[W.HEAD]), "rejected: head", None),
    "bool_provider": (subject(**{W.PROVIDER: K.scalar(W.PROVIDER, False)}), "rejected: provider", None),
    "float_provider": (subject(**{W.PROVIDER: K.scalar(W.PROVIDER, 0.0)}), "rejected: provider", None),
    "no_provider": (subject(**{W.PROVIDER: K.scalar(W.PROVIDER, 0)}), "recorded", []),
    "long_name": (subject(**{W.NAME: K.scalar(W.NAME, "é" * 2049)}), "rejected: name", None),
    "infinite_offset": (subject(**{W.LEVEL: level(offset=float("inf"))}), "recorded", [W.LEVEL]),
    "order": (subject(**{W.LEVEL: level(fields=("offset", "name", "description"))}), "recorded", [W.LEVEL]),
    "wrong_size": (subject(**{W.LEVELS: K.element(W.LEVELS, level(W.ITEM), Size=2)}), "recorded", [W.LEVELS]),
    "too_many": (subject(**{W.LEVELS: K.element(W.LEVELS, *[level(W.ITEM)] * 257, Size=257)}), "recorded", [W.LEVELS]),
    "other_item": (subject(**{W.LEVELS: K.element(W.LEVELS, level("thing"), Size=1)}), "recorded", [W.LEVELS]),
    "no_levels": (subject(**{W.LEVELS: K.element(W.LEVELS, Size=0)}), "recorded", []),
    "long_uwi": (subject(**{W.UWI: K.scalar(W.UWI, "x" * 4097)}), "recorded", [W.UWI]),
    "bare": (subject(drop=[W.UWI, W.LEVEL, W.LEVELS, W.CONVERGENCE]), "recorded", [W.UWI, W.LEVEL, W.CONVERGENCE, W.LEVELS]),
    "text_number": (subject(**{W.CONVERGENCE: K.scalar(W.CONVERGENCE, "1.5")}), "recorded", [W.CONVERGENCE]),
}


def test_each_departure(spark):
    rows = [(n, bytearray(K.container([x[0].replace(TAG.encode(), str(uuid.UUID(int=k + 100)).encode())]))) for k, (n, x) in enumerate(CASES.items())]
    rows += [("bad", bytearray(b"nothing")), ("other", bytearray(K.container([K.element("Grid", K.scalar("name", "g"))]))), ("again", rows[0][1])]
    nodes = settle(C.node_table(spark.createDataFrame([(*r, "clash") for r in rows], "path string, content binary, object_id string")), "nodes")
    got = {r.path: r for r in W.subjects(nodes).collect()}
    assert set(got) == {*CASES, "again"}
    for name, (_, status, gaps) in CASES.items():
        if name == "good":  # the same container is there again
            assert got["good"].status == got["again"].status == "duplicate" and got["good"].object_id is None
        else:
            assert got[name].status == status, name
            assert [g.field for g in got[name].gaps or ()] == (gaps or []), name
    (good,) = W.subjects(nodes.where("path = 'good'")).collect()
    assert good.working_level.asDict() == {"name": "KB", "offset": 303.206, "description": " Kelly bushing"}
    assert [x.asDict() for x in good.levels] == [good.working_level.asDict()]
    assert (good.object_id, good.provider_id, good.x, good.y, good.uwi) == (str(uuid.UUID(int=100)), PROVIDER, *XY, "Declared")
    assert got["no_provider"].provider_id is None and got["bare"].levels is None
    assert W.subjects(nodes.limit(0)).collect() == [] and W.heads(nodes.limit(0)).collect() == []


def test_heads_and_binding(spark):
    second = subject(**{W.TAG: K.scalar(W.TAG, OTHER), W.PROVIDER: K.scalar(W.PROVIDER, uuid.UUID(OTHER))})
    late = K.element(W.SUBJECT, K.element(W.HEAD, K.array("double", XY)), K.scalar(W.NAME, "late"))
    blank = K.element(W.SUBJECT, K.scalar(W.NAME, " "), K.element(W.HEAD, K.array("double", XY)))
    twice = subject(extra=[K.element(W.HEAD, K.array("double", XY))])
    documents = [subject(), K.element("Grid"), second, late, blank, twice, subject(drop=[W.HEAD])]
    nodes = settle(C.node_table(spark.createDataFrame([("m", bytearray(K.container(documents)))], "path string, content binary")), "nodes")
    found = settle(W.heads(nodes), "heads")
    got = [(r.subject, r.status, r.well_name, r.provider_status, r.same_name) for r in found.orderBy("document").collect()]
    assert got == [
        (0, "decoded", "DMS-1", "exact", 2), (1, "decoded", "DMS-1", "exact", 2), (2, "rejected: name", None, None, None), (3, "rejected: name", None, None, None),
        (4, "rejected: several heads", None, None, None), (5, "rejected: no head", None, None, None),
    ]
    known = settle(W.subjects(nodes), "subjects")
    bound = {r.subject: (r.identity, r.object_id) for r in W.bound_heads(found, known).collect()}
    assert bound[0] == ("exact", TAG) and bound[1] == ("exact", OTHER) and bound[2] == ("unresolved", None)
    moved = found.withColumn("x", found.x + 1e-9)
    assert {r.identity for r in W.bound_heads(moved, known).where("status = 'decoded'").collect()} == {"conflict"}
    assert {r.identity for r in W.bound_heads(found.union(found), known).collect()} == {"unresolved"}
    assert {r.identity for r in W.bound_heads(found, known.union(known)).collect()} == {"unresolved"}
    assert W.bound_heads(found, known.limit(0)).where("object_id is not null").count() == 0


def test_fields_serve_heads_and_subjects(spark):
    nodes = spark.createDataFrame([], "path string, document int, node int, parent int, name string, type string, text string, numbers array<double>, status string")
    found = W.fields(nodes)
    assert W.heads(nodes, found).collect() == W.subjects(nodes, found).collect() == []
