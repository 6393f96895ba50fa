"""Title blocks: from placed text to lines, parties of a title zone, their organisations and chief engineers, and the declared section.

Text pieces become lines by page and height; the pages of a title zone split into parties. Organisations are found in
lines and in runs of neighbouring lines; people stand near the line that names their office, which is a range join on
height inside a page, over bins as high as the range. A section is declared in a block of lines, which is matched to known titles.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, tokens
from .titles import effective_author, party_role, structure_status

# What names a legal form, a chief engineer, a person, and what a quoted name is not.
LEGAL_FORM = (
    r"\b(?:ООО|АО|ПАО|ОАО|ЗАО|МУП|ГУП|ГБУ|ГКУ|МБУ|ИП|общество\s+с\s+ограниченной\s+ответственностью|акционерное\s+общество)\b"
    r"|(?:^|\W)(?:ооо|000)(?:$|\W)"
    r"|(?:^|\W)о[бд]щество\s+с\s+ограниченн\w*\s+ответственност\w*(?:$|\W)"
)
ENGINEER = (
    r"(?:^|\W)(?:ГИП|главн\w*\s+инженер\w*\s+проекта)(?:$|\W)"
    r"|(?:^|\W)(?:г|т)ла[бв]н\w*\s+инженер\w*\s+проект\w*(?:$|\W)"
    r"|(?:^|\W)(?:г|т)ла[бв]н\w*\s+инженер\w*\s+прое"
)
PERSON = r"\b([А-ЯЁ][а-яё-]{2,})\s+([А-ЯЁ])\.?\s*([А-ЯЁ])?\.?\b"
PERSON_PREFIX = r"\b([А-ЯЁ])\.?\s*([А-ЯЁ])?\.?\s+([А-ЯЁ][а-яё-]{2,})\b"
QUOTED = r"[«\"“].{2,}[»\"”]"
NO_NAME = r"\b(?:банк|заказчик|капитальн|раздел|документац)\w*"
SHORT_FORM = r"(?:ООО|000|АО|ПАО|ОАО|ЗАО|МУП|ГУП|ИП)(?:\s+[А-ЯA-Z]{1,4})?"
LONGEST_NAME, RUN, REACH, PEOPLE = 120, 3, 80, 3
# Where a section is declared, and what ends its block.
ANCHOR = "проектная документация"
SECTION = r"\bраздел\s*(?:№\s*)?(\d+(?:\.\d+)*)"
SUBSECTION = r"\bподраздел\s*(?:№\s*)?(\d+(?:\.\d+)*)"
BLOCK_END = r"\b(?:раздел|подраздел)\s*(?:№\s*)?\d|\b(?:том|шифр|заказчик|застройщик|гип|главн\w*\s+инженер|генеральн\w*\s+директор|проверил|разработал|дата)\b"
SCOPE_LINES, BLOCK_LINES = 35, 5
# The subsections of section five, and the other sections with their titles.
SUBSECTIONS = (
    ("ЭС", "Система электроснабжения"),
    ("ВС", "Система водоснабжения"),
    ("ВО", "Система водоотведения"),
    ("ВК", "Система водоснабжения и водоотведения"),
    ("ОВ", "Отопление, вентиляция и кондиционирование воздуха"),
    ("СС", "Сети связи"),
    ("ГС", "Система газоснабжения"),
)
SECTIONS = (
    ("ПЗ", "Пояснительная записка", "Пояснительная записка"),
    ("СПОЗУ", "Схема планировочной организации земельного участка", "Схема планировочной организации земельного участка"),
    ("АР", "Объемно-планировочные и архитектурные решения", "Объемно-планировочные и архитектурные решения"),
    ("АР", "Объемно-планировочные и архитектурные решения", "Архитектурные решения"),
    ("КР", "Конструктивные решения", "Конструктивные решения"),
    ("ООС", "Мероприятия по охране окружающей среды", "Мероприятия по охране окружающей среды"),
    ("ПОС", "Проект организации строительства", "Проект организации строительства"),
    ("ПОС", "Проект организации строительства", "Проект организации капитального ремонта"),
    ("ПБ", "Мероприятия по обеспечению пожарной безопасности", "Мероприятия по обеспечению пожарной безопасности"),
    ("ТБЭ", "Требования к безопасной эксплуатации", "Требования к безопасной эксплуатации"),
    ("ТБЭ", "Требования к безопасной эксплуатации", "Требования к обеспечению безопасной эксплуатации"),
    ("ОДИ", "Мероприятия по обеспечению доступа инвалидов", "Мероприятия по обеспечению доступа инвалидов"),
    ("СМ", "Смета на строительство", "Смета на строительство"),
    ("СМ", "Смета на строительство", "Смета на капитальный ремонт"),
)
NO_TITLE_WORDS = ("подраздел", "система", "раздел")
#: What two words agree by, what a title is made of, when it is resolved and when it is at least ambiguous.
SAME_START, START_LIKENESS, WORD_LIKENESS = 6, 0.95, 0.82
RECALL, PRECISION, PHRASE = 0.65, 0.25, 0.10
RESOLVED, MARGIN, AMBIGUOUS = 0.62, 0.10, 0.45


def _has(text: Column, pattern: str, flags: str = "iU") -> Column:
    return text.rlike(f"(?{flags})(?:{pattern})")


def visual_lines(pieces: DataFrame) -> DataFrame:
    """doc_id, page, y, text, normalized: pieces (doc_id, page, x, y, text) at the same rounded height are one line, from left to right.

    Pieces without text are left out; halves round to even.
    """
    said = pieces.where(F.trim("text") != "").withColumn("y", F.bround("y").cast("bigint"))
    lines = said.groupBy("doc_id", "page", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.trim("text").alias("text"))))["text"].alias("texts"))
    return lines.select("doc_id", "page", "y", F.array_join("texts", " ").alias("text")).withColumn("normalized", normalize_text(F.col("text")))


def party_groups(pages: DataFrame) -> DataFrame:
    """doc_id, page, party, groups, zone_pages: title pages (doc_id, page) in order; beyond two, the first two are one party and the rest another."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    every = F.count("*").over(Window.partitionBy("doc_id"))
    rows = pages.select("doc_id", "page").distinct().select("doc_id", "page", place.alias("place"), every.alias("zone_pages"))
    return rows.select("doc_id", "page", F.when(F.col("place") <= 2, 1).otherwise(2).alias("party"), F.when(F.col("zone_pages") > 2, 2).otherwise(1).alias("groups"), "zone_pages")


def line_runs(lines: DataFrame, keys: list[str], most: int = RUN) -> DataFrame:
    """keys, page, seen, text, y: each line, and each run of 2 .. ``most`` lines of its page from it, downwards and upwards, with the least height.

    lines: keys, page, y, text. ``seen`` is the order of single lines first, then of runs downwards, then upwards.
    """
    page = [*keys, "page"]
    down, up = Window.partitionBy(*page).orderBy("y"), Window.partitionBy(*page).orderBy(F.desc("y"))
    line = F.struct("text", "y")
    rows = lines
    for name, window in (("down", down), ("up", up)):
        rows = rows.withColumns({f"{name}_at": F.row_number().over(window), **{f"{name}{k}": F.lead(line, k).over(window) for k in range(1, most)}})
    place = lambda k, at, size: F.struct(F.lit(k).alias("pass"), "page", F.col(at).alias("at"), F.lit(size).alias("size")).alias("seen")
    runs = [F.struct(place(0, "down_at", 1), F.array(line).alias("lines"))]
    for k, name in enumerate(("down", "up"), 1):
        for size in range(2, most + 1):
            run = F.struct(place(k, f"{name}_at", size), F.array(line, *[F.col(f"{name}{i}") for i in range(1, size)]).alias("lines"))
            runs.append(F.when(F.col(f"{name}{size - 1}").isNotNull(), run))
    rows = rows.select(*page, F.explode(F.array_compact(F.array(*runs))).alias("run"))
    return rows.select(*page, "run.seen", F.array_join(F.col("run.lines.text"), " ").alias("text"), F.array_min("run.lines.y").alias("y"))


def clean_organization(text: Column) -> Column:
    """The quoted name with the legal form before it; the whole text where nothing is quoted."""
    out = F.trim(text)
    for opening, inside, closing in (("[\"“]", "[^\"”]", "[\"”]"), ("«", "[^»]", "»")):  # the last that is tried wins
        quoted = rf"(?sU)^(.*?){opening}\s*({inside}{{2,}}?)\s*{closing}"
        before, name = F.regexp_extract(text, quoted, 1), F.trim(F.regexp_extract(text, quoted, 2))
        forms = F.regexp_extract_all(before, F.lit(f"(?iU){SHORT_FORM}"), F.lit(0))
        form = F.coalesce(F.trim(F.try_element_at(forms, F.lit(-1))), F.lit(""))
        full = F.trim(F.concat(F.when(form == "000", "ООО").otherwise(form), F.lit(" «"), name, F.lit("»")))
        out = F.when(name != "", full).otherwise(out)
    return out


def organizations(lines: DataFrame) -> DataFrame:
    """Organisations named in the lines (doc_id, party, page, y, text) of each party, ranked: by pages, quoted name, legal form, height, times.

    What is kept of a name seen several times is how it was first seen.
    """
    runs = line_runs(lines, ["doc_id", "party"]).withColumn("normalized", normalize_text(F.col("text")))
    quoted = _has(F.col("text"), QUOTED, "s")
    legal = _has(F.col("text"), LEGAL_FORM)
    named = quoted & (F.length("text") <= LONGEST_NAME) & ~_has(F.col("normalized"), NO_NAME, "U")
    rows = runs.withColumns({"legal_form": legal, "quoted": quoted}).where(legal | named).withColumn("organization", clean_organization(F.col("text")))
    rows = rows.withColumn("organization_key", normalize_text(F.col("organization")))
    first = lambda c: F.min_by(c, "seen").alias(c)
    found = rows.groupBy("doc_id", "party", "organization_key").agg(
        first("organization"), first("legal_form"), first("quoted"), F.min_by("text", "seen").alias("organization_evidence"), F.countDistinct("page").alias("pages"), F.count("*").alias("times"), F.min("y").alias("y")
    )
    best = Window.partitionBy("doc_id", "party").orderBy(F.desc("pages"), F.desc("quoted"), F.desc("legal_form"), "y", F.desc("times"), "organization_key")
    return found.withColumn("place", F.row_number().over(best))


def people(lines: DataFrame) -> DataFrame:
    """People within REACH of a line that names a chief engineer, on its page: the nearest PEOPLE of each such line, ranked by party."""
    def matches(kind: int, pattern: str, surname: int, initials: tuple[int, int]) -> Column:
        group = lambda k: F.regexp_extract_all("text", F.lit(f"(?U){pattern}"), F.lit(k))
        zipped = F.arrays_zip(group(0).alias("raw"), group(surname).alias("surname"), group(initials[0]).alias("i"), group(initials[1]).alias("j"))
        one = lambda x, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), x["raw"].alias("raw"), x["surname"].alias("surname"), F.concat(x["i"], x["j"]).alias("initials"))
        return F.transform(zipped, one)

    both = F.concat(matches(0, PERSON, 1, (2, 3)), matches(1, PERSON_PREFIX, 3, (1, 2)))
    named = lines.select("doc_id", "party", "page", F.col("y").alias("name_y"), "text", F.floor(F.col("y") / REACH).alias("bin"), F.explode(both).alias("m"))
    offices = lines.where(_has(F.col("normalized"), ENGINEER)).select("doc_id", "party", "page", F.col("y").alias("office_y"), F.floor(F.col("y") / REACH).alias("b"))
    offices = offices.select("doc_id", "party", "page", "office_y", F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("bin"))
    near = offices.join(named, ["doc_id", "party", "page", "bin"]).withColumn("distance", F.abs(F.col("name_y") - F.col("office_y"))).where(F.col("distance") <= REACH)
    near = near.withColumn("surname", normalize_text(F.col("m.surname")))
    closest = Window.partitionBy("doc_id", "party", "page", "office_y").orderBy("distance", "surname", "name_y", "m.kind", "m.at")
    near = near.withColumn("k", F.row_number().over(closest)).where(F.col("k") <= PEOPLE)
    order = F.struct("distance", "office_y", "k")
    one = near.groupBy("doc_id", "party", "surname", F.col("m.initials").alias("initials"), "page").agg(F.min("distance").alias("distance"), F.min_by("m.raw", order).alias("person"), F.min_by("text", order).alias("person_evidence"), F.min(order).alias("order"))
    best = Window.partitionBy("doc_id", "party").orderBy("distance", "page", "surname", "order", "initials")
    return one.withColumn("place", F.row_number().over(best)).drop("order")


def parties(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """One row of each party of each title zone: its pages, role, organisation, chief engineer, confidence, and whether it is the author.

    pages: doc_id, page of the title zones; lines: those of visual_lines(). A party without lines has neither name.
    """
    groups = party_groups(pages)
    # stored lines take far less room than they do in memory: a plan that goes by their files' size would broadcast them
    rows = lines.hint("merge").join(groups, ["doc_id", "page"])
    found = groups.groupBy("doc_id", "party", "groups", "zone_pages").agg(F.array_join(F.array_sort(F.collect_list("page")).cast("array<string>"), ";").alias("title_pages"))
    for side, names in ((organizations(rows), ("organization", "organization_key", "organization_evidence")), (people(rows), ("person", "surname", "initials"))):
        kind = names[0]
        counted = side.groupBy("doc_id", "party").agg(F.count("*").alias(f"{kind}_count"), *[F.max(F.when(F.col("place") == 1, F.col(c))).alias(c) for c in names])
        found = found.join(counted, ["doc_id", "party"], "left").na.fill(0, [f"{kind}_count"]).na.fill("", list(names))
    both = (F.col("organization_count") > 0) & (F.col("person_count") > 0)
    confidence = F.when(both & (F.col("organization_count") == 1), "high").when(both, "medium").otherwise("low")
    structure = structure_status(F.col("groups"), F.col("zone_pages"))
    author, rule = effective_author(F.col("party"), F.col("groups"))
    return found.select(
        "doc_id", "party", "title_pages", party_role(F.col("party"), F.col("groups")).alias("role"), "organization", "organization_key", "organization_evidence", "organization_count",
        "person", "surname", "initials", "person_count", confidence.alias("confidence"), author.alias("effective_author"), rule.alias("author_rule"), structure.alias("structure_status"),
        ((confidence != "high") | (structure == "manual_review_title_structure")).alias("manual_review"),
    )


def _alike(left: str, right: str) -> float:
    if left == right:
        return 1.0
    if min(len(left), len(right)) >= SAME_START and left[:SAME_START] == right[:SAME_START]:
        return START_LIKENESS
    return SequenceMatcher(None, left, right).ratio()


def _title_score(seen: list[str], wanted: list[str]) -> float:
    if not seen or not wanted:
        return 0.0
    hits = sum(max(_alike(w, s) for s in seen) >= WORD_LIKENESS for w in wanted)
    phrase = SequenceMatcher(None, " ".join(wanted), " ".join(seen)).ratio()
    return round(RECALL * hits / len(wanted) + PRECISION * hits / len(seen) + PHRASE * phrase, 6)


def title_tokens(text: Column) -> Column:
    return F.filter(tokens(normalize_text(text)), lambda t: ~t.rlike(r"^\p{Nd}+$") & ~t.isin(*NO_TITLE_WORDS))


_MATCH = "code string, name string, score double, second_code string, second_name string, second_score double"


def match_title(spark_tokens: Column, titles: list[tuple[str, str, list[str]]]) -> Column:
    """Of (code, name, words) the best and the second best for a title's words: their codes, names and scores; a code scores by its best words."""

    @F.pandas_udf(_MATCH)
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, ...], tuple] = {}
        for words in batches:
            rows = []
            for w in words:
                key = tuple(w) if w is not None else ()
                if key not in known:
                    scores: dict[tuple[str, str], float] = {}
                    for code, name, wanted in titles:
                        scores[code, name] = max(scores.get((code, name), 0.0), _title_score(list(key), wanted))
                    first, second = sorted(((s, c, n) for (c, n), s in scores.items()), reverse=True)[:2]
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = (first[1], first[2], first[0], second[1], second[2], second[0])
                rows.append(known[key])
            yield pd.DataFrame(rows, columns=["code", "name", "score", "second_code", "second_name", "second_score"])

    return best(spark_tokens)


def _words(titles: tuple[tuple[str, ...], ...]) -> list[tuple[str, str, list[str]]]:
    """The titles' words by the rule of title_tokens(); their letters need no repair."""
    import re

    rule = lambda t: [w for w in re.findall(r"\w+", t.lower().replace("ё", "е")) if len(w) > 1 and not w.isdigit() and w not in NO_TITLE_WORDS]
    return [(row[0], row[1], rule(row[-1])) for row in titles]


def declared_sections(lines: DataFrame) -> DataFrame:
    """The section and subsection that a title zone's lines (doc_id, page, y, text) declare, as they are numbered, worded and matched.

    Lines count from the one that says ANCHOR, or the first, SCOPE_LINES of them. A block is the declaring line and those
    after it on its page, BLOCK_LINES in all, up to one that opens another field. Subsections are matched in section five only.
    """
    by_place = Window.partitionBy("doc_id").orderBy("page", "y")
    rows = lines.select("doc_id", "page", "y", F.trim("text").alias("text"), normalize_text(F.col("text")).alias("n"))
    rows = rows.withColumn("at", F.row_number().over(by_place))
    anchor = F.min(F.when(F.contains("n", F.lit(ANCHOR)), F.col("at"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("at", F.col("at") - F.coalesce(anchor, F.lit(1))).where((F.col("at") >= 0) & (F.col("at") < SCOPE_LINES))
    section, subsection = (F.regexp_extract("n", f"(?U){p}", 1) for p in (SECTION, SUBSECTION))
    rows = rows.withColumns({"section": section, "subsection": subsection, "ends": _has(F.col("n"), BLOCK_END, "U")})
    scoped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "page", "text", "section", "subsection", "ends"))).alias("lines"))  # SCOPE_LINES at most

    def first(test) -> Column:
        return F.try_element_at(F.filter("lines", test), F.lit(1))

    scoped = scoped.withColumns(
        {
            "section_number": F.coalesce(first(lambda x: x["section"] != "")["section"], F.lit("")), "subsection_number": F.coalesce(first(lambda x: x["subsection"] != "")["subsection"], F.lit("")),
            "s": first(lambda x: (x["section"] != "") & (x["subsection"] == "")), "u": first(lambda x: x["subsection"] != ""),
        }
    )

    def block(start: str) -> Column:
        """Texts of the block that begins at a line, without repeats; empty without a line."""
        opening = F.col(start)
        after = F.filter("lines", lambda x: (x["at"] > opening["at"]) & (x["at"] < opening["at"] + BLOCK_LINES))
        stop = F.try_element_at(F.filter(after, lambda x: x["ends"] | (x["page"] != opening["page"])), F.lit(1))["at"]
        kept = F.filter(after, lambda x: x["at"] < F.coalesce(stop, F.lit(1 << 30)))
        return F.when(opening.isNull(), "").otherwise(F.array_join(F.array_distinct(F.concat(F.array(opening["text"]), kept["text"])), " | "))

    out = scoped.select("doc_id", "section_number", "subsection_number", block("s").alias("section_text"), block("u").alias("subsection_text"))
    five = F.split("section_number", r"\.")[0] == "5"
    asked = {"subsection": five & (F.col("subsection_text") != ""), "section": (F.col("section_number") != "") & ~five}
    titles = {"subsection": _words(SUBSECTIONS), "section": _words(SECTIONS)}
    for kind, when in asked.items():
        m = F.when(when, F.col(f"_{kind}"))
        out = out.withColumn(f"_{kind}", match_title(title_tokens(F.when(when, F.col(f"{kind}_text"))), titles[kind]))
        margin = m["score"] - m["second_score"]
        resolved = (m["score"] >= RESOLVED) & (margin >= MARGIN)
        out = out.withColumns(
            {
                f"{kind}_code": F.when(resolved, m["code"]).otherwise(""), f"{kind}_name": F.when(resolved, m["name"]).otherwise(""), f"{kind}_score": m["score"], f"{kind}_second_code": F.coalesce(m["second_code"], F.lit("")),
                f"{kind}_second_score": m["second_score"], f"{kind}_margin": F.round(margin, 6),
                f"{kind}_match_status": F.when(~when, "not_evaluated").when(resolved, "resolved").when(m["score"] >= AMBIGUOUS, "ambiguous").otherwise("insufficient"),
            }
        ).drop(f"_{kind}")
    code = F.when(F.col("subsection_code") != "", F.col("subsection_code")).otherwise(F.col("section_code"))
    status = F.when(code != "", "resolved_from_title").when(F.col("subsection_text") != "", "subsection_text_found_kind_ambiguous").when(F.col("section_text") != "", "section_text_only").otherwise("not_found")
    return out.withColumns({"declared_code": code, "declared_status": status})
