"""Queries of the special joins, rosters and titles, and of registers in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as E
from ..operators import joins as J
from ..operators import registry as R
from ..operators import title_blocks as B
from ..operators import titles as Z
from ..storage import stored
from . import inputs as I


def range_join(spark, d):
    """Errors and clicks of a user at most an hour apart."""
    e = I.table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    l = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("t").alias("x"))
    r = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("t").alias("y"))
    return J.within(l, r, ["user_id"], "x", "y", 3600e6).select("user_id", "error_id", "click_id")


def containment_join(spark, d):
    """Parts with the longest brand-like word of a small list that their name holds."""
    names = spark.createDataFrame([(w,) for w in ("ring", "small ring", "bolt", "gear", "large", "plate")], "name string")
    return J.containing(I.table(spark, d, "part"), names, "p_name", "name").select("p_partkey", "found_name")


def fuzzy_titles(spark, d):
    """Part names against a list of titles."""
    return J.fuzzy_titles(I.table(spark, d, "part").select("p_partkey", "p_name"), "p_name", [("1", "small ring"), ("2", "large bolt"), ("3", "steel plate")])


def roster_overlap(spark, d):
    """Users seen on two days with the same type of event: shared users, Jaccard and both coverages."""
    rows = I.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "user_id").distinct()
    return J.set_overlap(rows, "day", "event_type", "user_id")


def trend_lines(spark, d):
    """The least-squares line of price over quantity for each supplier."""
    b, a = J.slope(F.col("l_quantity"), F.col("l_extendedprice"))
    return I.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(b, 3).alias("slope"), F.round(a, 2).alias("intercept"))


def attribute_registry(spark, d):
    """Attributes of customers in long form, with how many distinct values a segment and nation hold."""
    wide = I.table(spark, d, "customer").select("c_mktsegment", "c_nationkey", F.col("c_custkey").cast("string").alias("key"), F.round("c_acctbal", 0).cast("bigint").cast("string").alias("balance"))
    long = wide.unpivot(["c_mktsegment", "c_nationkey"], ["key", "balance"], "attribute", "value")
    out = long.groupBy("c_mktsegment", "c_nationkey", "attribute").agg(F.count("*").alias("objects"), F.countDistinct("value").alias("distinct_values"))
    return out.withColumn("consistent", F.col("distinct_values") == 1)


def rollup_counts(spark, d):
    """Orders by segment and status, with subtotals."""
    rows = I.table(spark, d, "orders").join(I.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("orders"), F.grouping_id().cast("bigint").alias("level"))



#: Signature lines of orders: a role, and a name made of the customer's number.
ROLE_LINES = ("Разработал", "Н. контроль", "Утвердил", "ГИП")
SURNAMES = ("Иванов", "Петрова", "Сидоров", "Кузнецова", "Орлов")


def _signature_lines(spark, d):
    """Lines of rosters: each order signs in its own way, some with the name on the role's line, some on the next."""
    o = I.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    role = pick(ROLE_LINES, F.col("o_orderkey"))
    name = F.concat(pick(SURNAMES, F.col("o_custkey")), F.lit(" "), F.lit("И. "), pick(("А.", "Б.", "В."), F.col("o_orderkey")))
    style = F.col("o_orderkey") % 3
    lines = F.when(style == 0, F.array(F.concat(role, F.lit(" "), name))).when(style == 1, F.array(role, name)).otherwise(F.array(role, F.substring_index(name, " ", 1)))
    rows = o.select("o_custkey", "o_orderkey", F.posexplode(lines).alias("k", "text"))
    return rows.select("o_custkey", "o_orderkey", F.col("k").alias("place"), "text")


def roster_people(spark, d):
    """People of each order's signature lines by role."""
    return J.roster(_signature_lines(spark, d), ["o_custkey", "o_orderkey"], "place", "text")


def roster_qc(spark, d):
    """Per customer: whether the person its title names is in its rosters."""
    people = roster_people(spark, d).select(F.col("o_custkey").alias("object_id"), "role", "surname_hash").distinct()
    objects = I.table(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), F.col("c_mktsegment").alias("org"))
    expected = F.element_at(F.array(*map(F.lit, SURNAMES)), (F.col("object_id") % 4 + 1).cast("int"))
    objects = objects.withColumn("surname_hash", F.when(F.col("object_id") % 7 != 0, J.surname_hash(expected)))
    files = I.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("object_id")).agg(F.count_if(F.col("o_orderstatus") != "P").alias("parsed"), F.count_if(F.col("o_orderstatus") == "P").alias("image_only"))
    return J.roster_status(objects, files, people).select("object_id", "org", "parsed", "image_only", "as_gip", "as_other", "status")


def roster_qc_ratio(spark, d):
    return J.roster_ratio(roster_qc(spark, d), "org")


def _groups(spark, d):
    """Conversations as title zones: a group of signatories for each user turn, two pages a group and one for longer answers."""
    c = I.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("groups"), (F.count("*") + F.max((F.length("text") > 400).cast("int"))).alias("pages"))


def title_structure(spark, d):
    return _groups(spark, d).select("conv_id", "groups", "pages", Z.structure_status(F.col("groups"), F.col("pages")).alias("status"))


def party_roles(spark, d):
    """The role of each group of a title zone, and whether it is the author."""
    rows = _groups(spark, d).where("groups > 0").withColumn("party", F.explode(F.sequence(F.lit(1), F.col("groups").cast("int"))))
    author, rule = Z.effective_author(F.col("party"), F.col("groups"))
    return rows.select("conv_id", "party", Z.party_role(F.col("party"), F.col("groups")).alias("role"), author.alias("effective_author"), rule.alias("rule"))


def section_resolution(spark, d):
    """Pages' languages as their addresses tell them against what their markup says."""
    rows = I.table(spark, d, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("title"), F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("selected"))
    title = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 5 == 0, "xx").otherwise(F.col("title"))
    return rows.select("page_id", Z.section_status(title, F.col("selected")).alias("status"), F.coalesce(F.nullif(title, F.lit("")), F.col("selected")).alias("effective"))


def line_windows(spark, d):
    """Lines of all documents joined with the one or two after and before them on their page."""
    rows = E.normalized_segments(E.segments(I.docs(spark, d)))
    lines = rows.select("doc_id", F.floor(F.col("seg_no") / E.PAGE_LINES).alias("page"), F.col("seg_no").cast("bigint").alias("y"), F.col("normalized").alias("text"))
    return B.line_runs(lines, ["doc_id"]).select("doc_id", "page", "y", F.col("text").alias("window"))


def zone_pieces(spark, d):
    """Title zones made of orders: a line is a piece of text on a page of its order, placed by quantity and discount.

    Returned lines name a person, accepted ones an organisation, the others an office; names are those of the suppliers'
    nations, written in Cyrillic.
    """
    nation = I.table(spark, d, "supplier").join(I.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cyrillic = F.initcap(F.translate(F.lower("n_name"), "abcdefghijklmnopqrstuvwxyz_0123456789", "абцдефгхийклмнопярстуввхузабвгдежзик"))
    nation = nation.select("s_suppkey", cyrillic.alias("name"))
    line = I.table(spark, d, "lineitem").join(nation, F.col("l_suppkey") == F.col("s_suppkey"))
    office = F.when(F.col("l_linestatus") == "O", "ГИП").otherwise("Главный инженер проекта")
    text = F.when(F.col("l_returnflag") == "R", F.concat("name", F.lit(" А.Б."))).when(F.col("l_returnflag") == "A", F.concat(F.lit("ООО «"), "name", F.lit("»"))).otherwise(office)
    # pieces at one place stand side by side in the order of their texts
    return line.select(F.col("l_orderkey").alias("doc_id"), F.ceil(F.col("l_linenumber") / 2).cast("int").alias("page"), F.col("l_discount").alias("x"), (F.col("l_quantity") * 5).alias("y"), text.alias("text"))


def title_parties(spark, d):
    """Parties of the title zone of each order, from its placed lines: organisation, engineer, role, author."""
    pieces = zone_pieces(spark, d)
    return B.parties(pieces.select("doc_id", "page"), stored(B.visual_lines(pieces), "title-lines"))


def most_common_brands(spark, d):
    """The three commonest brands of each part type."""
    return R.most_common(I.table(spark, d, "part"), ["p_type"], "p_brand", "p_partkey", 3)


def archive_ids(spark, d):
    """Numbers and years of orders in one text as archive ids."""
    o = I.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    short = F.lpad((F.col("y") % 100).cast("string"), 2, "0")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("_"), F.col("y").cast("string")))
    raw = raw.when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderkey").cast("string"), short)).otherwise(F.concat(F.col("o_orderkey").cast("string"), short, F.lit(".0")))
    return o.select("o_orderkey", T.archive_id(raw).alias("archive_id"))


def legal_forms(spark, d):
    """Suppliers named with a legal form, and the form found again."""
    forms = ("ООО", "АО", "ПАО", "общество с ограниченной ответственностью", "")
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s = I.table(spark, d, "supplier").select("s_suppkey", F.concat(form, F.lit(" «Проект "), F.col("s_suppkey").cast("string"), F.lit("»")).alias("name"))
    return s.select("s_suppkey", T.legal_form(F.col("name")).alias("form"), T.quoted_name(F.col("name")).alias("quoted"))


#: File names with the section they are of and the reason they are left out for (empty: they stay).
FILES = [
    ("src/0001_20/Раздел ПД №3 АР.pdf", "АР", ""), ("src/0001_20/Раздел 5.1 ЭС.pdf", "ИНЖЕНЕРИЯ", ""), ("src/0001_20/КР1.pdf", "КР", ""), ("src/0001_20/123-ПОКР изм1.pdf", "ПОС", ""),
    ("src/0001_20/Раздел 6 Проект организации работ.pdf", "ПОС", ""), ("src/0001_20/Смета.pdf", "СМ", ""), ("src/0001_20/ЛСР-02.pdf", "СМ", ""), ("src/0001_20/Система отопления.pdf", "ОВ", ""),
    ("src/0001_20/ПКР-12 ГВС.pdf", "ГВС", ""), ("src/0001_20/Фасад.pdf", "ФАСАД", ""), ("src/0001_20/что-то.pdf", "UNKNOWN", ""), ("src/0001_20/Пояснительная записка.pdf", "ПЗ", "пз"),
    ("src/0001_20/КАЦ.pdf", "КАЦ", "кац"), ("src/Договор/АР.pdf", "АР", "договор"), ("src/0001_20/ИУЛ АР.pdf", "АР", "иул"), ("src/0001_20/12. Паспорт.pdf", "UNKNOWN", "технический паспорт мкд"),
    ("src/0001_20/ТЗ на проект.pdf", "UNKNOWN", "тз"), ("src/0001_20/3 Письмо заказчика.pdf", "UNKNOWN", "письмо"), ("src/0001_20/2946-к от 01.02.2023.pdf", "UNKNOWN", "договор кчс"), ("src/0001_20/Акт осмотра.pdf", "UNKNOWN", "акт"),
    ("src/0001_20/Дефектная ведомость.pdf", "UNKNOWN", "дефектная ведомость"), ("src/0001_20/15 ис от 3.4.2022.pdf", "UNKNOWN", "исходящее"), ("src/0001_20/Смена_названия.pdf", "UNKNOWN", "решение о смене названия"),
]


def file_rules(spark, d):
    """A file name for each supplier: its section, and why it is left out."""
    from ..operators import selection as Q

    names = F.array(*[F.lit(n) for n, _, _ in FILES])
    rows = I.table(spark, d, "supplier").select("s_suppkey", F.element_at(names, (F.col("s_suppkey") % len(FILES) + 1).cast("int")).alias("path"))
    return rows.select("s_suppkey", Q.section_of(F.substring_index("path", "/", -1)).alias("section"), Q.left_out(F.col("path")).alias("reason"))


def either_filter(spark, d):
    """Documents that one or the other of two columns selects."""
    return I.table_docs(spark, d).where((F.col("section") == "es") | F.col("org").isin("src1", "src2")).select("doc_id", "section", "org")


QUERIES = {f.__name__: f for f in (
    range_join, containment_join, fuzzy_titles, roster_overlap, trend_lines, attribute_registry, rollup_counts, roster_people, roster_qc, roster_qc_ratio, title_structure, party_roles, section_resolution,
    line_windows, title_parties, most_common_brands, archive_ids, legal_forms, file_rules, either_filter,
)}

_W = I.with_
_pick = lambda names, k: "([" + ", ".join(f"'{n}'" for n in names) + f"])[{k} % {len(names)} + 1]"
# what an order's signature lines amount to: the name takes the role; styles 0 and 1 give initials, style 2 a surname alone
_PEOPLE = f"""sl as (select o_custkey, o_orderkey, o_orderkey % 3 style, {_pick(('developer', 'control', 'approved', 'gip'), 'o_orderkey')} role, {_pick(SURNAMES, 'o_custkey')} s, {_pick(('А.', 'Б.', 'В.'), 'o_orderkey')} i from orders),
pe as (
  select o_custkey, o_orderkey, role, sha1(replace(lower(case when style = 2 then s else s || ' И.' || i end), 'ё', 'е')) person_hash, sha1(replace(lower(s), 'ё', 'е')) surname_hash, case when style = 2 then 'surname_only' else 'surname_initials' end kind from sl)"""
_QC = _PEOPLE + f""",
fl as (select o_custkey, count(*) filter (o_orderstatus <> 'P') parsed, count(*) filter (o_orderstatus = 'P') image_only from orders group by 1),
ob as (select c_custkey, c_mktsegment org, case when c_custkey % 7 <> 0 then sha1(lower({_pick(SURNAMES[:4], 'c_custkey')})) end h from customer),
rs as (select o_custkey, count(*) filter (role = 'gip') as_gip, count(*) filter (role <> 'gip') as_other from (select distinct o_custkey, role, surname_hash from pe) p join ob on c_custkey = o_custkey and h = surname_hash group by 1),
qc as (
  select c_custkey object_id, org, coalesce(parsed, 0) parsed, coalesce(image_only, 0) image_only, coalesce(as_gip, 0) as_gip, coalesce(as_other, 0) as_other,
    case when coalesce(parsed, 0) = 0 and coalesce(image_only, 0) = 0 then 'no_iul_pdf' when coalesce(parsed, 0) = 0 then 'image_only_needs_ocr' when h is null then 'missing_title_gip_reference' when coalesce(as_gip, 0) > 0 then 'title_gip_observed_as_iul_gip'
      when coalesce(as_other, 0) > 0 then 'title_gip_observed_in_other_iul_role' else 'title_gip_not_observed_in_extracted_iul_roster' end status
  from ob left join fl on fl.o_custkey = c_custkey left join rs on rs.o_custkey = c_custkey)"""
_GR = "gr as (select conv_id, count(*) filter (role = 'user') \"groups\", count(*) + max((length(text) > 400)::int) pages from conversations group by 1)"
_AT = "case when page_id % 4 = 0 then '' when page_id % 5 = 0 then 'xx' else regexp_extract(html, 'lang=\"([a-z]+)\"', 1) end"

ORACLES = {
    "range_join": "select l.user_id, l.event_id error_id, r.event_id click_id from events l join events r on l.user_id = r.user_id and l.event_type = 'error' and r.event_type = 'click' and abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 3600000000",
    "containment_join": """with names(name) as (values ('ring'), ('small ring'), ('bolt'), ('gear'), ('large'), ('plate'))
select p_partkey, (select name from names where contains(p_name, name) or contains(name, p_name) order by length(name) desc, name desc limit 1) found_name from part""",
    "roster_overlap": """with r as (select distinct strftime(ts, '%Y-%m-%d') "day", event_type, user_id from events), z as (select "day", event_type, count(*) n from r group by all),
s as (select a."day" "left", b."day" "right", a.event_type, count(*) shared from r a join r b on a.event_type = b.event_type and a.user_id = b.user_id and a."day" < b."day" group by all)
select "left", "right", s.event_type, shared, round(shared / (l.n + x.n - shared), 4) jaccard, round(shared / l.n, 4) left_coverage, round(shared / x.n, 4) right_coverage
from s join z l on l."day" = "left" and l.event_type = s.event_type join z x on x."day" = "right" and x.event_type = s.event_type""",
    "trend_lines": "select l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 3) slope, round(regr_intercept(l_extendedprice, l_quantity), 2) intercept from lineitem group by 1",
    "attribute_registry": """with w as (select c_mktsegment, c_nationkey, c_custkey::varchar k, round(c_acctbal, 0)::bigint::varchar b from customer),
l as (select c_mktsegment, c_nationkey, 'key' attribute, k v from w union all select c_mktsegment, c_nationkey, 'balance', b from w)
select c_mktsegment, c_nationkey, attribute, count(*) objects, count(distinct v) distinct_values, count(distinct v) = 1 consistent from l group by all""",
    "rollup_counts": "select c_mktsegment, o_orderstatus, count(*) orders, grouping_id(c_mktsegment, o_orderstatus)::bigint as \"level\" from orders join customer on o_custkey = c_custkey group by rollup (c_mktsegment, o_orderstatus)",
    "roster_people": _W(_PEOPLE, "select * from pe"),
    "roster_qc": _W(_QC, "select * from qc"),
    "roster_qc_ratio": _W(_QC, """select org, count(*) objects, count(*) filter (status like 'title_gip_%') comparable, count(*) filter (status = 'title_gip_observed_as_iul_gip') as_gip, count(*) filter (status = 'title_gip_observed_in_other_iul_role') as_other,
  count(*) filter (status = 'title_gip_not_observed_in_extracted_iul_roster') absent, round(coalesce(count(*) filter (status like 'title_gip_observed%') / nullif(count(*) filter (status like 'title_gip_%'), 0), 0) + 1e-9::double, 4) ratio from qc group by 1"""),
    "title_structure": _W(_GR, "select *, case when \"groups\" = 1 and pages = 2 then 'single_party_expected' when \"groups\" = 2 and pages = 4 then 'lead_and_subcontractor_expected' else 'manual_review_title_structure' end status from gr"),
    "party_roles": _W(_GR, """select conv_id, party, case when party = 1 then 'lead_designer' when party = 2 and "groups" = 2 then 'subcontractor' else 'unresolved' end role, (party = 2 and "groups" = 2) or (party = 1 and "groups" = 1) effective_author,
  case when party = 2 and "groups" = 2 then 'subcontractor_actual_author' when "groups" = 1 then 'sole_designer_author' else 'lead_contractual_not_effective_author' end rule from (select *, unnest(range(1, "groups" + 1))::int party from gr)"""),
    "section_resolution": f"""select page_id, case when t <> '' and t = s then 'title_matches_selection' when t <> '' then 'title_overrides_selection' else 'selection_fallback' end status, coalesce(nullif(t, ''), s) effective
from (select page_id, {_AT} t, regexp_extract(url, '/(en|fr|de|es)/', 1) s from pages)""",
    "line_windows": _W(I.SEGS, """select doc_id, page, unnest(ys) y, unnest(windows) as window from (
  select doc_id, page, list_filter([n, n || ' ' || u1, n || ' ' || u1 || ' ' || u2, n || ' ' || l1, n || ' ' || l1 || ' ' || l2], lambda x: x is not null) windows,
    list_filter([y, case when u1 is not null then y end, case when u2 is not null then y end, yl1, yl2], lambda x: x is not null) ys from (
    select doc_id, page, y, n, lead(n, 1) over w u1, lead(n, 2) over w u2, lag(n, 1) over w l1, lag(n, 2) over w l2, lag(y, 1) over w yl1, lag(y, 2) over w yl2
    from (select doc_id, seg_no // 20 page, seg_no y, normalized n from norm) window w as (partition by doc_id, page order by y)))"""),
    "most_common_brands": """select p_type, string_agg(p_brand || ':' || n, '|' order by k) most_common from (select *, row_number() over (partition by p_type order by n desc, seen) k from (select p_type, p_brand, count(*) n, min(p_partkey) seen from part group by all)) where k <= 3 group by 1""",
    "archive_ids": """select o_orderkey, case when o_orderkey % 3 = 0 then lpad(o_orderkey::varchar, greatest(4, length(o_orderkey::varchar))::int, '0') || '_' || lpad((year(o_orderdate) % 100)::varchar, 2, '0')
  else lpad(o_orderkey::varchar, greatest(4, length(o_orderkey::varchar))::int, '0') || '_' || lpad((year(o_orderdate) % 100)::varchar, 2, '0') end archive_id from orders""",
    "legal_forms": "select s_suppkey, (['ООО', 'АО', 'ПАО', 'ООО', ''])[s_suppkey % 5 + 1] form, 'Проект ' || s_suppkey quoted from supplier",
    "file_rules": "with f(k, section, reason) as (values " + ", ".join(f"({k}, '{s}', '{r}')" for k, (_, s, r) in enumerate(FILES)) + f") select s_suppkey, section, reason from supplier join f on s_suppkey % {len(FILES)} = k",
    "either_filter": "select doc_id, lang section, source org from documents where lang = 'es' or source in ('src1', 'src2')",
}
