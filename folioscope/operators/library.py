"""Recurring elements: candidates, how they belong to organisations, evidence samples, coverage of documents, combined reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hex_of, is_blank, stable_id, tokens
from ..storage import by_key, stored
from .entities import SHINGLE, normalized_segments, segments, text_places
from .frequency import idf

#: Least organisations' lead, most document share of a bridge, least tokens and characters of a segment.
DISTINCTIVE, BRIDGE, TOKENS, CHARS = 0.25, 0.25, 3, 12
KEY = ["section", "entity_kind", "entity_hash"]


def _classed(by_org: DataFrame, key: list[str], least_objects: int, sizes: DataFrame, sections: DataFrame, bridge: float, *more: Column) -> DataFrame:
    """Of rows of each key (section is one) and organisation, with objects and docs: those keys that ``least_objects`` objects have,
    their counts, leading organisation (_first, _second, _delta) and classes."""
    by_org = by_org.join(F.broadcast(sizes), ["section", "org"]).withColumn("ratio", F.col("objects") / F.col("org_objects"))
    found = by_org.groupBy(*key).agg(
        F.sum("objects").alias("object_count"), F.sum("docs").alias("document_count"), F.count("*").alias("org_count"),
        F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ratio", "org", "objects")))), 1, 2).alias("lead"), *more,
    ).where(F.col("object_count") >= least_objects)
    out = found.join(F.broadcast(sections), "section")
    first, second = F.col("lead")[0], F.coalesce(F.try_element_at("lead", F.lit(2))["ratio"], F.lit(0.0))
    delta = first["ratio"] - second
    org_class = F.when(F.col("org_count") == 1, "org_specific").when(delta >= DISTINCTIVE, "org_distinctive").otherwise("cross_org_common")
    share = F.col("document_count") / F.col("section_documents")
    out = out.withColumns({"_first": first, "_second": second, "_delta": delta, "org_class": org_class, "org_scope": F.when(F.col("org_count") > 1, "cross_org").otherwise("single_org"), "_share": share})
    kind = (
        F.when(F.col("org_scope") != "cross_org", "org_text_pattern")
        .when((F.col("org_class") == "cross_org_common") | (F.col("_share") > bridge), "normative_text")
        .otherwise("cross_org_text_bridge")
    )
    out = out.withColumn("candidate_class", kind)
    signal = F.when(F.col("candidate_class") == "cross_org_text_bridge", "copy_review_needed").when(F.col("candidate_class") == "normative_text", "normative_or_boilerplate").otherwise("org_pattern")
    return out.withColumn("signal", signal)


def candidates(entities: DataFrame, least_objects: int = 3, id_base: str = "text_element_candidate_v0", id_prefix: str = "txtc_v0_", bridge: float = BRIDGE, whole: DataFrame | None = None) -> DataFrame:
    """Entities of a section in ``least_objects`` or more objects, with the organisations that hold them, classes and status.

    ``entities`` has doc_id, section, object_id, org, entity_kind, entity_hash, n, tokens, chars. An organisation's
    ratio is the share of its objects in the section that hold the entity; the largest ratio dominates, on a tie the
    larger name. Short segments are kept, as diagnostic_trivial. Organisations are few: a row of each entity and
    organisation is gathered into one text. Entities are shuffled once, by KEY; those of too few objects are left out
    before anything of them is gathered. Hashes may be binary; ids are made of their hex digits. Where entities are only those that
    recur, ``whole`` has section, object_id, org and doc_id of all documents with entities.
    """
    whole = entities.select("section", "object_id", "org", "doc_id").distinct() if whole is None else whole
    sizes = whole.groupBy("section", "org").agg(F.countDistinct("object_id").alias("org_objects"))
    sections = whole.groupBy("section").agg(F.countDistinct("object_id").alias("section_objects"), F.countDistinct("doc_id").alias("section_documents"))
    dealt = by_key(entities.select(*KEY, "org", "object_id", "n", "tokens", "chars"), *KEY, times=4)
    by_object = dealt.groupBy(*KEY, "org", "object_id").agg(F.count("*").alias("docs"), F.sum("n").alias("occurrences"), F.max("tokens").alias("tokens"), F.max("chars").alias("chars"))
    by_org = by_object.groupBy(*KEY, "org").agg(
        F.count("*").alias("objects"), F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"), F.max("tokens").alias("tokens"), F.max("chars").alias("chars")
    )
    by_org = by_org.withColumn("_objects", F.sum("objects").over(Window.partitionBy(*KEY))).where(F.col("_objects") >= least_objects)
    counts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("org", c))), lambda x: F.concat_ws(":", x["org"], x[c].cast("string"))), "|")
    more = [
        F.sum("occurrences").alias("occurrence_count"), F.max("tokens").alias("token_count"), F.max("chars").alias("char_count"),
        counts("objects").alias("org_object_counts"), counts("occurrences").alias("org_occurrence_counts"),
    ]
    out = _classed(by_org, KEY, least_objects, sizes, sections, bridge, *more)
    first, second, delta, signal = (F.col(c) for c in ("_first", "_second", "_delta", "signal"))
    short = F.when(F.col("entity_kind") == "text_segment", F.array_compact(F.array(F.when(F.col("token_count") < TOKENS, f"token_count<{TOKENS}"), F.when(F.col("char_count") < CHARS, f"char_count<{CHARS}"))))
    reason = F.coalesce(F.array_join(short, "|"), F.lit(""))
    round4 = lambda c: F.round(c + 1e-9, 4)
    binary = dict(out.dtypes)["entity_hash"] == "binary"
    return out.select(
        stable_id(id_prefix, id_base, *[hex_of(F.col(c)) if binary and c == "entity_hash" else F.col(c) for c in KEY]).alias("candidate_id"), *KEY, "candidate_class", "object_count", "document_count", "occurrence_count",
        "section_objects", "section_documents", round4(F.col("object_count") / F.col("section_objects")).alias("object_ratio"), round4(F.col("_share")).alias("document_ratio"),
        F.round(idf(F.col("document_count"), F.col("section_documents")), 4).alias("section_idf"), "org_scope", "org_class", first["org"].alias("dominant_org"), first["objects"].alias("dominant_objects"),
        round4(first["ratio"]).alias("dominant_ratio"), round4(second).alias("second_ratio"), round4(delta).alias("delta"), "org_object_counts", "org_occurrence_counts", signal,
        "token_count", "char_count", reason.alias("triviality_reason"), F.when(reason == "", "candidate").otherwise("diagnostic_trivial").alias("candidate_status"), "org_count",
    )


def with_text(docs: DataFrame) -> DataFrame:
    """section, object_id, org, doc_id of the documents that have text entities: those with a line that is not blank."""
    return docs.where(F.exists(F.split("text", "\n"), lambda line: ~is_blank(line))).select("section", "object_id", "org", "doc_id")


def recurring_entities(entities: DataFrame, docs: DataFrame, least_objects: int = 3, parts: int = 1) -> DataFrame:
    """Of entities (as of candidates(), not stored), those that may be a candidate's: of ``least_objects`` documents and two objects at least.

    A row of each document and entity is shuffled once, with numbers in place of names; what is left, a fifth or less, is stored.
    docs: section, object_id, org of the documents; parts: partitions at least.
    """
    whos = stored(docs.select(*_WHO).distinct().withColumn("who", _who()), "objects")
    whos = F.broadcast(whos) if whos.count() <= SENT else whos
    of, segment = Window.partitionBy("entity_hash", "segment"), F.col("entity_kind") == "text_segment"
    rows = by_key(entities.select("entity_hash", _who(), "doc_id", segment.alias("segment"), "n", "tokens", "chars"), "entity_hash", times=4, least=parts)
    rows = rows.withColumns({"_n": F.count("*").over(of), "_low": F.min("who").over(of), "_high": F.max("who").over(of)})
    rows = rows.where((F.col("_n") >= least_objects) & (F.lit(least_objects < 2) | (F.col("_low") != F.col("_high")))).drop("_n", "_low", "_high")
    kind = F.when(F.col("segment"), "text_segment").otherwise("text_word_shingle")
    return stored(rows, "recurring-entities").join(whos, "who").withColumn("entity_kind", kind).drop("who", "segment")


def evidence(entities: DataFrame, found: DataFrame, most: int = 20) -> DataFrame:
    """At most ``most`` documents of each candidate: some of every organisation first, then in order of organisation and id."""
    rows = entities.select(*KEY, "org", "doc_id", "n").join(found.select("candidate_id", *KEY, "org_count"), KEY)
    seed = F.greatest(F.lit(1), F.floor(F.floor(F.lit(most) / F.col("org_count")) / 2))
    rows = rows.withColumn("in_org", F.row_number().over(Window.partitionBy("candidate_id", "org").orderBy("doc_id")))
    order = Window.partitionBy("candidate_id").orderBy(F.when(F.col("in_org") <= seed, 0).otherwise(1), "org", "doc_id")
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= most).select("candidate_id", "org", "doc_id", "n", "place")


def coverage(documents: DataFrame, entities: DataFrame, found: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Per document: of each kind and of all, occurrences, those that candidates match and their ratio; of the matched
    ones the expected (common, or led by the own organisation) and foreign (led by another), and those to be reviewed.

    documents: doc_id, section, org; kinds: entity kind to the prefix of its columns. Trivial candidates don't match.
    Documents without entities are no_text; ratios over nothing are 0. A document of no known organisation (null, empty or
    UNKNOWN) expects nothing and has nothing foreign.
    """
    used = found.where("candidate_status = 'candidate'").select(*KEY, "candidate_id", "org_class", "dominant_org", "signal")
    rows = entities.where(F.col("entity_kind").isin(*kinds)).join(used, KEY, "left")
    matched, known = F.col("candidate_id").isNotNull(), F.coalesce(~F.col("org").isin("", "UNKNOWN"), F.lit(False))
    common = F.col("org_class") == "cross_org_common"
    expected = matched & known & (common | (F.col("dominant_org") == F.col("org")))
    foreign = matched & known & ~common & (F.col("dominant_org") != F.col("org"))
    n = lambda ok, kind=None: F.sum(F.when(ok if kind is None else ok & (F.col("entity_kind") == kind), F.col("n")).otherwise(0))
    every = F.lit(True)
    out = rows.groupBy("doc_id").agg(
        *[n(c, k).alias(f"{p}_{name}") for k, p in kinds.items() for name, c in (("total", every), ("matched", matched), ("expected", expected))],
        n(every).alias("all_total"), n(matched).alias("all_matched"), n(expected).alias("expected"), n(foreign).alias("foreign"),
        n(matched & (F.col("signal") == "copy_review_needed")).alias("copy_review"), F.countDistinct("candidate_id").alias("candidates"),
    )
    return _ratios(documents, out, kinds)


def _ratios(documents: DataFrame, counts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The documents with their counts (0 without) and what coverage() makes of them."""
    out = documents.select("doc_id", "section", "org").join(counts, "doc_id", "left").na.fill(0, [c for c in counts.columns if c != "doc_id"])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) + 1e-9, 4)
    more = {}
    for p in kinds.values():
        more |= {f"{p}_ratio": ratio(f"{p}_matched", f"{p}_total"), f"{p}_residual": F.col(f"{p}_total") - F.col(f"{p}_matched"), f"{p}_conformance": ratio(f"{p}_expected", f"{p}_matched")}
    more |= {
        "all_ratio": ratio("all_matched", "all_total"), "conformance": ratio("expected", "all_matched"), "foreign_ratio": ratio("foreign", "all_matched"),
        "copy_review_ratio": ratio("copy_review", "all_total"), "coverage_status": F.when(F.col("all_total") == 0, "no_text").otherwise("measured"),
    }
    return out.withColumns(more).drop(*[f"{p}_expected" for p in kinds.values()])


#: Objects and rows of one number that are sent to all executors, at most.
SENT = 1 << 20
_WHO = ["section", "object_id", "org"]


def _numbered_places(docs: DataFrame) -> DataFrame:
    """code, who, doc_id, kind of each place of a text entity of a known section: the numbers of entity and object, and 0 of a
    shingle, 1 of a segment, 2 of one too short to be a candidate."""
    segment = F.col("entity_kind") == "text_segment"
    short = segment & ((F.size("words") < TOKENS) | (F.length("value") < CHARS))
    kind = F.when(short, 2).when(segment, 1).otherwise(0).cast("tinyint")
    return text_places(segments(docs.where("section is not null"))).select(F.xxhash64("section", "entity_kind", "value").alias("code"), _who(), "doc_id", kind.alias("kind"))


def _who() -> Column:
    return F.xxhash64(*_WHO, *[F.isnull(c) for c in _WHO]).alias("who")


def recurring(places: DataFrame, least_objects: int, parts: int) -> DataFrame:
    """code, who, doc_id, kind, n of what has ``least_objects`` places or more, of two objects at least: all that may be a
    candidate's; the rest, four fifths and more, goes no further than the one shuffle."""
    of = Window.partitionBy("code")
    rows = by_key(places, "code", least=parts).withColumns({"_n": F.count("*").over(of), "_low": F.min("who").over(of), "_high": F.max("who").over(of)})
    rows = rows.where((F.col("_n") >= least_objects) & (F.lit(least_objects < 2) | (F.col("_low") != F.col("_high"))))
    return rows.groupBy("code", "who", "doc_id", "kind").agg(F.count("*").alias("n"))


def text_coverage(documents: DataFrame, texts: DataFrame, kinds: dict[str, str], parts: int = 1, least_objects: int = 3, bridge: float = BRIDGE) -> DataFrame:
    """coverage() of documents by the candidates() of their own text entities, without a row of text or digest for any of them.

    texts: the documents with their texts, dealt out by doc_id; parts: partitions at least. A place of an entity is shuffled
    once, as three numbers; of those, what recurs is stored, and joined with its candidates by the same number.
    """
    lines = normalized_segments(segments(texts)).withColumn("words", F.size(tokens(F.col("normalized"))))
    totals = lines.groupBy("doc_id", *_WHO).agg(F.count("*").alias("segments"), F.sum(F.greatest(F.col("words") - (SHINGLE - 1), F.lit(0))).alias("shingles"))
    totals = stored(totals, "text-totals")
    sizes = totals.groupBy("section", "org").agg(F.countDistinct("object_id").alias("org_objects"))
    sections = totals.groupBy("section").agg(F.countDistinct("object_id").alias("section_objects"), F.countDistinct("doc_id").alias("section_documents"))
    whos = stored(totals.select(*_WHO).distinct().select(_who(), "section", "org"), "objects")
    whos = F.broadcast(whos) if whos.count() <= SENT else whos

    rows = by_key(stored(recurring(_numbered_places(texts), least_objects, parts), "recurring"), "code", least=parts)
    by_object = rows.groupBy("code", "kind", "who").agg(F.count("*").alias("docs")).join(whos, "who")
    by_org = by_object.groupBy("code", "kind", "section", "org").agg(F.count("*").alias("objects"), F.sum("docs").alias("docs"))
    used = _classed(by_org, ["section", "code", "kind"], least_objects, sizes, sections, bridge).where("kind < 2")
    used = used.select("code", (F.col("org_class") == "cross_org_common").alias("common"), F.col("_first")["org"].alias("led"), (F.col("signal") == "copy_review_needed").alias("copy"))

    matched = rows.join(used, "code").join(whos.select("who", "org"), "who")
    known = F.coalesce(~F.col("org").isin("", "UNKNOWN"), F.lit(False))
    own = F.coalesce(F.col("led") == F.col("org"), F.lit(False))
    n = lambda ok: F.sum(F.when(ok, F.col("n")).otherwise(0))
    found = matched.groupBy("code", "doc_id", "kind").agg(F.sum("n").alias("matched"), n(known & (F.col("common") | own)).alias("x"), n(known & ~F.col("common") & ~own).alias("f"), n(F.col("copy")).alias("c"))
    named = {"text_segment": (1, "segments"), "text_word_shingle": (0, "shingles")}
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0))
    found = by_key(found.drop("code"), "doc_id", least=parts).groupBy("doc_id").agg(
        *[of(named[k][0], c).alias(f"{p}_{name}") for k, p in kinds.items() for name, c in (("matched", "matched"), ("expected", "x"))],
        F.sum("matched").alias("all_matched"), F.sum("x").alias("expected"), F.sum("f").alias("foreign"), F.sum("c").alias("copy_review"), F.count("*").alias("candidates"),
    )
    every = [F.sum(named[k][1]).alias(f"{p}_total") for k, p in kinds.items()]
    counts = totals.groupBy("doc_id").agg(*every, F.sum(F.col("segments") + F.col("shingles")).alias("all_total")).join(found, "doc_id", "left")
    order = [f"{p}_{name}" for p in kinds.values() for name in ("total", "matched", "expected")]
    return _ratios(documents, counts.select("doc_id", *order, "all_total", "all_matched", "expected", "foreign", "copy_review", "candidates"), kinds)


def coverage_band(ratio: Column) -> Column:
    return F.when(ratio >= 0.75, "high").when(ratio >= 0.40, "medium").otherwise("low")


def review_priority(foreign: Column, copy_review: Column, table_borrowing: Column) -> Column:
    """Borrowed tables or much to be reviewed come first, then foreign text or a little to be reviewed."""
    return (
        F.when((table_borrowing > 0) | (copy_review >= 0.05), "review_high")
        .when((foreign >= 0.05) | (copy_review >= 0.005), "review_watch")
        .otherwise("review_clear")
    )


def combined_report(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """One row of each document in either coverage: both ratios, bands and statuses (missing without a row), and its priority.

    tables: coverage by table forms; texts: coverage by text candidates.
    """
    l = tables.select("doc_id", "section", "org", F.col("coverage_ratio").alias("table_ratio"), F.col("borrowing").alias("table_borrowing"), F.col("coverage_status").alias("table_status"))
    r = texts.select("doc_id", "section", "org", F.col("all_ratio").alias("text_ratio"), "foreign_ratio", "copy_review_ratio", F.col("coverage_status").alias("text_status"))
    out = l.join(r, ["doc_id", "section", "org"], "full_outer")
    out = out.withColumns({c: F.coalesce(c, F.lit("missing")) for c in ("table_status", "text_status")})
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("table_ratio", "text_ratio", "foreign_ratio", "copy_review_ratio")}).withColumn("table_borrowing", F.coalesce("table_borrowing", F.lit(0)))
    return out.withColumns(
        {"table_band": coverage_band(F.col("table_ratio")), "text_band": coverage_band(F.col("text_ratio")), "priority": review_priority(F.col("foreign_ratio"), F.col("copy_review_ratio"), F.col("table_borrowing"))}
    )
