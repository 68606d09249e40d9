"""Typed wells out of node tables: subjects, their declared references, heads, and the exact binding of one to the other.

A profile is a pattern of paths, types and order. Nodes are folded upwards in three aggregations (values into elements, elements into the elements above, those into lists), so a
subject is matched by joins on (document, parent) and never parsed as a whole. A subject that departs from the profile in what identifies it is a row with a status; a departure in an
optional field is a gap of that field. Labels and offsets stay as they are stored: no unit, sign or datum is inferred.

Nodes are rows (path, document, node, parent, name, type, text, numbers, status) of ``containers`` or ``streamed``. Null, rejected and foreign rows are left out. Repeated documents are
subjects of their own, and equal identifiers make each other ``duplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import ranged

# Names of the profile, its namespace and version, and bounds.
SUBJECT = "WellTraceSubject"
NAMESPACE = "http://www.slb.com/Petrel/2011/03/Serialization"
VERSION = (33, 3, 14, 1, 2, 21, 0, 0, 1)
TAG, NAME, PROVIDER, HEAD, UWI = "unique_tag", "name", "definite_survey_provider_tag_", "well_head_", "uwi_"
LEVEL, LEVELS, ITEM, CONVERGENCE = "working_reference_level", "reference_levels", "item", "grid_convergence_factor"
LEVEL_FIELDS = ("name", "offset", "description")
MOST_TEXT, MOST_LEVELS, MOST_COORDINATE = 4096, 256, 1e15
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
NO_UUID = "00000000-0000-0000-0000-000000000000"

_DOC = ["path", "document"]
_TEXTS = ("text", "uuid")


def _sorted(value: Column) -> Column:
    return F.array_sort(F.collect_list(value))


def elements(nodes: DataFrame) -> DataFrame:
    """A row for each element: its place, name, attributes, number of elements and arrays in it, its arrays, and ``kind`` and ``value`` of its one scalar (null kind: none that is unambiguous)."""
    inner = nodes.where("parent is not null and status = 'ok'")
    text, attribute = F.col("name") == "", F.col("name").startswith("@")
    array, element = F.col("numbers").isNotNull(), F.col("type") == "element"
    held = inner.groupBy(*_DOC, F.col("parent").alias("node")).agg(
        _sorted(F.when(text, F.struct("node", "type", "text"))).alias("texts"),
        _sorted(F.when(attribute, F.struct("name", "type", "text"))).alias("attributes"),
        _sorted(F.when(array, F.struct("node", "name", "type", "numbers"))).alias("arrays"),
        F.count_if(element | array).alias("children"),
    )
    own = nodes.where("type = 'element' and status = 'ok'").select(*_DOC, "node", "parent", "name")
    out = own.join(held, [*_DOC, "node"], "left")
    texts = F.coalesce("texts", F.array())
    joined = F.array_join(F.transform("texts", lambda t: t["text"]), "")
    all_text = F.forall("texts", lambda t: t["type"].isin(*_TEXTS))
    kind = F.when(F.coalesce("children", F.lit(0)) > 0, None).when(F.size(texts) == 0, "text").when(F.size(texts) == 1, F.get("texts", F.lit(0))["type"]).when(all_text, "text")
    return out.select(
        *_DOC, "node", "parent", "name", F.coalesce("attributes", F.array()).alias("attributes"), F.coalesce("arrays", F.array()).alias("arrays"),
        F.size(texts).alias("n_texts"), F.coalesce("children", F.lit(0)).alias("n_children"), kind.alias("kind"),
        F.when(F.size(texts) == 0, "").otherwise(joined).alias("value"),
    )


def with_children(found: DataFrame) -> DataFrame:
    """Elements with ``kids``, the elements in each, in order, with their scalars."""
    one = F.struct("node", "name", "kind", "value")
    kids = found.where("parent is not null").groupBy(*_DOC, F.col("parent").alias("node")).agg(_sorted(one).alias("kids"))
    return found.join(kids, [*_DOC, "node"], "left")


def _is_text(kind: Column, value: Column) -> Column:
    return kind.isin(*_TEXTS) & (F.octet_length(value) <= MOST_TEXT)


def _number(kind: Column, value: Column) -> Column:
    """The finite number of a typed scalar, else null."""
    n = F.when(kind.isin("int", "float"), value.try_cast("double"))
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def _uuid(kind: Column, value: Column) -> Column:
    return F.when(kind.isin(*_TEXTS) & value.rlike(UUID) & (value != NO_UUID), value)


def _level() -> Column:
    """The reference level that an element states (name, offset, description), null where it departs from the profile."""
    k = [F.get("kids", F.lit(i)) for i in range(3)]
    shape = (F.size("attributes") == 0) & (F.col("n_texts") == 0) & (F.size("arrays") == 0) & (F.size("kids") == 3)
    shape = shape & F.coalesce(F.transform("kids", lambda x: x["name"]) == F.array(*(F.lit(n) for n in LEVEL_FIELDS)), F.lit(False))
    offset = _number(k[1]["kind"], k[1]["value"])
    good = shape & _is_text(k[0]["kind"], k[0]["value"]) & offset.isNotNull() & _is_text(k[2]["kind"], k[2]["value"])
    return F.when(good, F.struct(k[0]["value"].alias("name"), offset.alias("offset"), k[2]["value"].alias("description")))


def _attribute(name: str) -> Column:
    return F.filter("attributes", lambda a: a["name"] == f"@{name}")


def shapes(nodes: DataFrame) -> DataFrame:
    """Direct children of each subject: (path, document, name, kind, value, ..., level, levels, sound), level and levels being the references they state."""
    roots = nodes.where(F.col("parent").isNull() & (F.col("name") == SUBJECT) & (F.col("status") == "ok")).select(*_DOC)
    own = nodes.where("status = 'ok'").join(roots.distinct(), _DOC, "left_semi")
    found = with_children(elements(own)).withColumn("level", _level())
    parts = found.where(F.col("name").isin(LEVEL, LEVELS, ITEM, TAG, NAME, PROVIDER, HEAD, UWI, CONVERGENCE) | F.col("parent").isNull())
    items = found.where("parent is not null").groupBy(*_DOC, F.col("parent").alias("node")).agg(
        _sorted(F.struct("node", "level")).alias("items"), F.bool_and((F.col("name") == ITEM) & F.col("level").isNotNull()).alias("sound")
    )
    size = _attribute("Size")
    n = F.when((F.size("attributes") == 1) & (F.size(size) == 1) & (F.get(size, F.lit(0))["type"] == "int"), F.get(size, F.lit(0))["text"].try_cast("long"))
    whole = n.between(0, MOST_LEVELS) & (F.col("n_texts") == 0) & (F.size("arrays") == 0) & (F.col("n_children") == n) & F.coalesce("sound", F.lit(True))
    levels = F.when(whole, F.transform(F.coalesce("items", F.array()), lambda x: x["level"]))
    return parts.join(items, [*_DOC, "node"], "left").withColumn("levels", levels)


def _head() -> tuple[Column, Column]:
    """The two coordinates of a head element, null where it is none."""
    one = F.get("arrays", F.lit(0))
    shape = (F.size("attributes") == 0) & (F.col("n_texts") == 0) & (F.col("n_children") == 1) & (F.size("arrays") == 1)
    shape = shape & (one["name"] == "double") & one["type"].isin("<f8", "<f4") & (F.size(one["numbers"]) == 2)
    xy = [F.get(one["numbers"], F.lit(i)) for i in (0, 1)]
    for v in xy:
        shape = shape & ~F.isnan(v) & (F.abs(v) <= MOST_COORDINATE)
    return tuple(F.when(shape, v) for v in xy)


def _fields(parts: DataFrame) -> DataFrame:
    """One row for each subject: of each field how often it is there, and its content."""
    roots = parts.where("parent is null").select(*_DOC, F.col("node").alias("root"), "attributes")
    children = parts.where("parent is not null").drop("attributes").join(roots.select(*_DOC, F.col("root").alias("parent")), [*_DOC, "parent"])
    aggregates = []
    for name in (TAG, NAME, PROVIDER, HEAD, UWI, CONVERGENCE, LEVEL, LEVELS):
        here = F.col("name") == name
        content = F.struct("node", "kind", "value", "level", "levels", "x", "y")
        aggregates += [F.count_if(here).alias(f"n_{name}"), F.min_by(F.when(here, content), F.when(here, F.col("node"))).alias(name)]
    return roots.join(children.groupBy(*_DOC).agg(*aggregates), _DOC, "left").fillna(0, [f"n_{n}" for n in (TAG, NAME, PROVIDER, HEAD, UWI, CONVERGENCE, LEVEL, LEVELS)])


def _scalar(name: str) -> tuple[Column, Column]:
    """Kind and value of a field; an absent one is the empty text, a repeated one is of no kind."""
    n, content = F.col(f"n_{name}"), F.col(name)
    return F.when(n == 0, "text").when(n == 1, content["kind"]), F.when(n == 0, "").otherwise(content["value"])


def fields(nodes: DataFrame) -> DataFrame:
    """A row for each subject with what its fields hold: what ``subjects`` and ``heads`` are told from. Written once, it serves both."""
    parts = shapes(nodes)
    x, y = _head()
    return _fields(parts.withColumns({"x": F.when(F.col("name") == HEAD, x), "y": F.when(F.col("name") == HEAD, y)}))


def subjects(nodes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(path, document, status, object_id, name, provider_id, x, y, uwi, working_level, levels, convergence, gaps): a row for each subject document; all but the first three are null unless the status is
    ``recorded``. gaps: (field, reason) of optional fields, in order of the fields. ``found``: ``fields`` of the nodes, if there already."""
    found = fields(nodes) if found is None else found
    version = "[" + ",".join(map(str, VERSION)) + "]"
    space, stated = _attribute("xmlns"), _attribute("Version")
    profile = (F.size(space) == 1) & (F.get(space, F.lit(0))["text"] == NAMESPACE) & (F.size(stated) == 1) & (F.get(stated, F.lit(0))["type"] == "list") & (F.get(stated, F.lit(0))["text"] == version)
    tag = _uuid(*_scalar(TAG))
    kind, value = _scalar(PROVIDER)
    none = (kind.isin(*_TEXTS) & (value == "")) | ((kind == "int") & (value == "0"))
    provider = _uuid(kind, value)
    x, y = (F.when(F.col(f"n_{HEAD}") == 1, F.col(HEAD)[c]) for c in "xy")
    no = F.lit(False)
    status = (
        F.when(~F.coalesce(profile, no), "rejected: profile").when(tag.isNull(), "rejected: object id")
        .when(~F.coalesce(none, no) & provider.isNull(), "rejected: provider").when(x.isNull() | y.isNull(), "rejected: head")
        .when(~F.coalesce(_is_text(*_scalar(NAME)), no), "rejected: name").otherwise("recorded")
    )
    uwi_kind, uwi = _scalar(UWI)
    number_kind, number = _scalar(CONVERGENCE)
    content = {
        UWI: F.when(_is_text(uwi_kind, uwi), uwi), LEVEL: F.when(F.col(f"n_{LEVEL}") == 1, F.col(LEVEL)["level"]), CONVERGENCE: _number(number_kind, number),
        LEVELS: F.when(F.col(f"n_{LEVELS}") == 1, F.col(LEVELS)["levels"]),
    }
    there = {n: F.when(F.col(f"n_{n}") > 0, c) for n, c in content.items()}
    gap = [
        F.when(there[n].isNull(), F.struct(F.lit(n).alias("field"), F.when(F.col(f"n_{n}") == 0, "not present").when(F.col(f"n_{n}") > 1, "repeated").otherwise("outside the profile").alias("reason")))
        for n in (UWI, LEVEL, CONVERGENCE, LEVELS)
    ]
    made = found.select(
        *_DOC, status.alias("status"), tag.alias("object_id"), _scalar(NAME)[1].alias("name"), F.when(~F.coalesce(none, no), provider).alias("provider_id"), x.alias("x"), y.alias("y"),
        there[UWI].alias("uwi"), there[LEVEL].alias("working_level"), there[LEVELS].alias("levels"), there[CONVERGENCE].alias("convergence"), F.array_compact(F.array(*gap)).alias("gaps"),
    )
    again = made.where("status = 'recorded'").groupBy("object_id").agg((F.count("*") > 1).alias("again"))
    made = made.join(again, "object_id", "left")
    status = F.when((F.col("status") == "recorded") & F.col("again"), "duplicate").otherwise(F.col("status"))
    made = made.withColumn("status", status)
    return made.select(*_DOC, "status", *(F.when(F.col("status") == "recorded", F.col(c)).alias(c) for c in ("object_id", "name", "provider_id", "x", "y", "uwi", "working_level", "levels", "convergence", "gaps")))


def heads(nodes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(path, document, subject, status, well_name, provider_id, provider_status, x, y, same_name): a head for each subject, whatever its profile; ``subject`` counts the subjects of a container from 0.
    A bad one is a row with a status. same_name: how many heads of the container have the name."""
    found = fields(nodes) if found is None else found
    kind, value = (F.col(NAME)[c] for c in ("kind", "value"))  # the first of several, ahead of the head
    named = (F.col(f"n_{NAME}") > 0) & F.coalesce(_is_text(kind, value) & (F.trim(value) != ""), F.lit(False))
    pkind, pvalue = (F.col(PROVIDER)[c] for c in ("kind", "value"))
    before = F.coalesce(F.col(PROVIDER)["node"] < F.col(HEAD)["node"], F.lit(False))
    named = named & F.coalesce(F.col(NAME)["node"] < F.col(HEAD)["node"], F.lit(False))
    linked = F.coalesce(before & (pkind == "uuid") & pvalue.rlike(UUID), F.lit(False))
    empty = ~before | F.coalesce(pkind.isin(*_TEXTS) & (pvalue == ""), F.lit(False))
    status = F.when(F.col(f"n_{HEAD}") == 0, "rejected: no head").when(F.col(f"n_{HEAD}") > 1, "rejected: several heads").when(~named, "rejected: name")
    status = status.when(F.col(HEAD)["x"].isNull(), "rejected: coordinates").otherwise("decoded")
    good = status == "decoded"
    made = found.select(
        *_DOC, status.alias("status"), F.when(good, value).alias("well_name"), F.when(good & linked, pvalue).alias("provider_id"),
        F.when(good, F.when(linked, "exact").when(empty, "none").otherwise("unrecognized")).alias("provider_status"),
        *(F.when(good, F.col(HEAD)[c]).alias(c) for c in "xy"),
    )
    counts = made.where("well_name is not null").groupBy("path", "well_name").agg(F.count("*").alias("same_name"))
    numbered = ranged(made.join(counts, ["path", "well_name"], "left"), ["path"], ["document"])
    return numbered.undealt(numbered.numbered("subject").withColumn("subject", F.col("subject").cast("int")))


def bound_heads(found: DataFrame, subject_rows: DataFrame) -> DataFrame:
    """Heads with ``identity`` and, where it is exact, the subject's object_id and uwi: one head and one recorded subject have the provider, and names and coordinates are equal. Nearness or names alone bind nothing."""
    known = subject_rows.where("status = 'recorded' and provider_id is not null")
    one = known.groupBy(F.col("provider_id").alias("of")).agg(
        F.count("*").alias("owners"), F.min(F.struct("object_id", "name", "x", "y", "uwi")).alias("owner")
    )
    claims = found.where("provider_id is not null").groupBy(F.col("provider_id").alias("by")).agg(F.count("*").alias("claims"))
    met = found.join(one, F.col("provider_id") == F.col("of"), "left").join(claims, F.col("provider_id") == F.col("by"), "left")
    single = (F.col("provider_status") == "exact") & (F.col("claims") == 1) & (F.col("owners") == 1)
    o = F.col("owner")
    same = (F.col("well_name") == o["name"]) & (F.col("x") == o["x"]) & (F.col("y") == o["y"])
    identity = F.when(~F.coalesce(single, F.lit(False)), "unresolved").when(F.coalesce(same, F.lit(False)), "exact").otherwise("conflict")
    out = met.withColumn("identity", identity)
    exact = F.col("identity") == "exact"
    return out.select(*found.columns, "identity", F.when(exact, o["object_id"]).alias("object_id"), F.when(exact, o["uwi"]).alias("uwi"))
