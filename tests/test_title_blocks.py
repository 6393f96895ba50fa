"""Title blocks: the examples of the rules, and parties of random title zones against the rules written plainly."""

import os
import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from folioscope.operators import title_blocks as B

LINE = "doc_id bigint, page int, y bigint, text string"


def normalize(text):
    return re.sub(r"\s+", " ", text.translate(str.maketrans("ÐðÖöÞþ", "РрЦцЮю")).lower().replace("ё", "е")).strip()


def declared(spark, *zones):
    rows = [(k, page, y, text) for k, zone in enumerate(zones) for page, y, text in zone]
    return [r for r in sorted(B.declared_sections(spark.createDataFrame(rows, LINE)).collect(), key=lambda r: r["doc_id"])]


def test_declared_sections(spark):
    doc = (1, 10, "ПРОЕКТНАЯ ДОКУМЕНТАЦИЯ")
    five = (1, 20, "Раздел 5 Сведения об инженерном оборудовании, о сетях")
    power, generic, heat, apart, other, before, pages, water = declared(
        spark,
        [doc, five, (1, 30, "Подраздел 5.1 «Система электроснабжения»")],
        [doc, five],
        [doc, five, (1, 30, "Подраздел 4. Отопление, вентиляция и кондиционирование воздуха,"), (1, 40, "тепловые сети."), (1, 50, "Шифр 123-ОВ")],
        [doc, five, (1, 30, "Обособленное подразделение фактический адрес")],
        [doc, (1, 20, "Раздел № 4 «Конструктивные решения»"), (1, 25, "ГИП Иванов И.И."), (1, 30, "Конструктивные решения")],
        [(1, 1, "Раздел 9. Пояснительная записка"), (1, 5, "проектная  документация"), (1, 9, "Раздел 1. Пояснительная записка")],
        [doc, (1, 20, "Раздел 5"), (2, 1, "Подраздел 3"), (3, 1, "Система водоотведения")],
        [doc, (1, 20, "Раздел 5"), (1, 22, "Подраздел 2. Система водоснабжения и водоотведения")],
    )
    assert (power["section_number"], power["subsection_number"], power["declared_code"], power["declared_status"]) == ("5", "5.1", "ЭС", "resolved_from_title")
    assert "Сведения об инженерном оборудовании" in power["section_text"] and power["section_match_status"] == "not_evaluated"
    assert (generic["declared_code"], generic["declared_status"]) == ("", "section_text_only")
    assert heat["subsection_number"] == "4" and heat["declared_code"] == "ОВ" and "тепловые сети" in heat["subsection_text"] and "Шифр" not in heat["subsection_text"]
    assert (apart["subsection_number"], apart["declared_code"], apart["declared_status"]) == ("", "", "section_text_only")
    assert (other["section_number"], other["declared_code"], other["section_text"]) == ("4", "КР", "Раздел № 4 «Конструктивные решения»")
    assert before["section_number"] == "1" and before["declared_code"] == "ПЗ"
    assert pages["subsection_text"] == "Подраздел 3" and pages["declared_status"] == "subsection_text_found_kind_ambiguous"
    assert water["declared_code"] == "ВК"
    assert declared(spark, [(1, 1, "нет")])[0]["declared_status"] == "not_found"


def plain_titles(text, titles):
    words = lambda t: [w for w in re.findall(r"\w+", normalize(t)) if len(w) > 1 and not w.isdigit() and w not in ("подраздел", "система", "раздел")]

    def alike(a, b):
        return 1.0 if a == b else 0.95 if min(len(a), len(b)) >= 6 and a[:6] == b[:6] else SequenceMatcher(None, a, b).ratio()

    scores = {}
    for row in titles:
        seen, wanted = words(text), words(row[-1])
        hits = sum(max(alike(w, s) for s in seen) >= 0.82 for w in wanted) if seen else 0
        score = round(0.65 * hits / len(wanted) + 0.25 * hits / len(seen) + 0.1 * SequenceMatcher(None, " ".join(wanted), " ".join(seen)).ratio(), 6) if seen else 0.0
        scores[row[:2]] = max(score, scores.get(row[:2], 0.0))
    return sorted(((s, c, n) for (c, n), s in scores.items()), reverse=True)[:2]


def test_titles_match_as_the_rule_says(spark):
    rng = random.Random(5)
    words = [w for row in B.SECTIONS + B.SUBSECTIONS for w in row[-1].split()] + ["Раздел", "том", "сети", "решёния", "Архитектурное", "7", "ab"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(7))) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for titles in (B.SECTIONS, B.SUBSECTIONS):
        got = frame.select("k", B.match_title(B.title_tokens(frame["t"]), B._words(titles)).alias("m")).collect()
        for r in got:
            (s1, c1, n1), (s2, c2, n2) = plain_titles(texts[r["k"]], titles)
            assert tuple(r["m"]) == (c1, n1, s1, c2, n2, s2)


def plain_parties(zones, lines):
    """(doc, party) -> organisation key, count, surname, initials, count, confidence, role, author by the rules in plain Python."""
    out = {}
    for doc, pages in zones.items():
        pages = sorted(set(pages))
        groups = [pages] if len(pages) <= 2 else [pages[:2], pages[2:]]
        for party, own in enumerate(groups, 1):
            rows = sorted(x for x in lines[doc] if x[0] in own)
            runs = [[x] for x in rows]
            orders = [rows] + [[x for x in rows if x[0] == p][::-1] for p in sorted({x[0] for x in rows})]
            for ordered in orders:
                for i, x in enumerate(ordered):
                    same = [z for z in ordered[i : i + 3] if z[0] == x[0]]
                    runs += [same[:n] for n in range(2, len(same) + 1)]
            found = {}
            for run in runs:
                text = " ".join(x[2] for x in run)
                legal = bool(re.search(B.LEGAL_FORM, text, re.I))
                quoted = bool(re.search(B.QUOTED, text))
                if not legal and not (quoted and len(text) <= 120 and not re.search(B.NO_NAME, normalize(text))):
                    continue
                m = re.search(r"«\s*([^»]{2,}?)\s*»", text) or re.search(r"[\"“]\s*([^\"”]{2,}?)\s*[\"”]", text)
                name = text.strip()
                if m:
                    forms = re.findall(B.SHORT_FORM, text[: m.start()], re.I)
                    form = forms[-1].strip() if forms else ""
                    name = f"{'ООО' if form == '000' else form} «{m[1].strip()}»".strip()
                item = found.setdefault(normalize(name), {"quoted": quoted, "legal": legal, "y": run[0][1], "pages": set(), "n": 0})
                item["pages"].add(run[0][0])
                item["n"] += 1
                item["y"] = min([item["y"], *(x[1] for x in run)])
            orgs = sorted(found, key=lambda k: (-len(found[k]["pages"]), -found[k]["quoted"], -found[k]["legal"], found[k]["y"], -found[k]["n"], k))  # noqa: B023
            near = {}
            for page, y, text in rows:
                if not re.search(B.ENGINEER, normalize(text), re.I):
                    continue
                hits = []
                for p2, y2, t2 in rows:
                    if p2 == page and abs(y2 - y) <= 80:
                        hits += [(abs(y2 - y), normalize(m[1]), (m[2] or "") + (m[3] or "")) for m in re.finditer(B.PERSON, t2)]
                        hits += [(abs(y2 - y), normalize(m[3]), (m[1] or "") + (m[2] or "")) for m in re.finditer(B.PERSON_PREFIX, t2)]
                for d, surname, initials in sorted(hits, key=lambda h: h[:2])[:3]:
                    near[surname, initials, page] = min(d, near.get((surname, initials, page), 10**9))
            people = sorted((d, page, s, i) for (s, i, page), d in near.items())
            confidence = "high" if len(orgs) == 1 and people else "medium" if orgs and people else "low"
            role = "lead_designer" if party == 1 else "subcontractor"
            out[doc, party] = (orgs[0] if orgs else "", len(orgs), people[0][2] if people else "", len(people), confidence, role, role == "subcontractor" or len(groups) == 1)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_parties_follow_the_rules(spark, seed):
    rng = random.Random(seed)
    texts = [
        "ООО «Альфа»", "000 \"Бета\"", "АО", "«Гамма проект»", "Заказчик «Дельта»", "ГИП", "Главный инженер проекта", "Тлавный инженер прое", "Иванов И.И.", "П.С. Петрова", "Сидоров-Краснов А", "ГИП Орлов О. О.",
        "Общество с ограниченной ответственностью", "ПАО ГК “Эпсилон”", "Раздел 1", "шифр 12", "Том 2  Альфа", "ИП Жуков Ж.Ж.", "ничего", "Ёлкин Ё.Ё. и Иванов И.И.",
    ]
    zones, lines = {}, defaultdict(list)
    for doc in range(40):
        zones[doc] = [rng.randrange(1, 7) for _ in range(rng.randrange(1, 7))]
        for page in range(1, 7):
            for y in rng.sample(range(0, 400, 10), rng.randrange(7)):
                lines[doc].append((page, y, rng.choice(texts)))
    rows = [(doc, page, 0.0, float(y), text) for doc, x in lines.items() for page, y, text in x]
    placed = B.visual_lines(spark.createDataFrame(rows, "doc_id bigint, page int, x double, y double, text string"))
    pages = spark.createDataFrame([(d, p) for d, ps in zones.items() for p in ps], "doc_id bigint, page int")
    got = {(r["doc_id"], r["party"]): (r["organization_key"], r["organization_count"], r["surname"], r["person_count"], r["confidence"], r["role"], r["effective_author"]) for r in B.parties(pages, placed).collect()}
    assert got == plain_parties(zones, lines)
    assert {x[4] for x in got.values()} == {"high", "medium", "low"}


def test_pieces_become_lines(spark):
    pieces = [(1, 1, 5.0, 10.5, " второй "), (1, 1, 1.0, 9.6, "первый"), (1, 1, 0.0, 11.5, "ниже"), (1, 1, 0.0, 3.0, "  "), (1, 2, 0.0, 10.0, "там")]
    rows = B.visual_lines(spark.createDataFrame(pieces, "doc_id bigint, page int, x double, y double, text string")).collect()
    assert {(r["page"], r["y"], r["text"]) for r in rows} == {(1, 10, "первый второй"), (1, 12, "ниже"), (2, 10, "там")}


def test_names_of_organisations(spark):
    cases = {
        "Проектировщик 000 «Альфа  плюс »": "ООО «Альфа  плюс»", "«Бета»": "«Бета»", "АО НПО \"Гамма\" и «Дельта»": "АО НПО «Дельта»", "ООО “Эта”": "ООО «Эта»", " ООО Тета ": "ООО Тета", "«я»": "«я»",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in frame.select("t", B.clean_organization(frame["t"])).collect()} == cases


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_query_is_the_plain_one(spark):
    from folioscope.plans import score_queries as Q

    d = "/root/testdata/sf0.001"
    pieces, lines = defaultdict(list), defaultdict(list)
    for r in Q.zone_pieces(spark, d).collect():
        pieces[r["doc_id"], r["page"], round(r["y"])].append((r["x"], r["text"]))
    for (doc, page, y), texts in pieces.items():
        lines[doc].append((page, y, " ".join(t for _, t in sorted(texts))))
    got = {(r["doc_id"], r["party"]): (r["organization_key"], r["organization_count"], r["surname"], r["person_count"], r["confidence"], r["role"], r["effective_author"]) for r in Q.title_parties(spark, d).collect()}
    want = plain_parties({doc: [x[0] for x in rows] for doc, rows in lines.items()}, lines)
    assert got == want and {x[4] for x in got.values()} == {"high", "medium", "low"}


def test_stored_lines_are_not_broadcast(spark):
    from folioscope.storage import stored

    lines = stored(spark.range(1000).selectExpr("id doc_id", "1 page", "id y", "'ООО «Альфа»' text", "'ооо «альфа»' normalized"), "lines")
    pages = stored(spark.range(1000).selectExpr("id doc_id", "1 page"), "pages")
    plan = B.parties(pages, lines)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[doc_id#\d+L?, page#\d+\]", plan) and not re.search(r"BroadcastHashJoin \[doc_id#\d+L?, page#\d+\]", plan)
