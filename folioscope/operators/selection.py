"""Files by their names: which are left out and why, and which section a file is of. The first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import classify

_ALONE = r"(?<![0-9A-ZА-ЯЁ])({})(?![0-9A-ZА-ЯЁ])"

#: Section codes and what the upper-cased file name is found by, in order.
SECTIONS = [
    ("ПЗ", r"^1___23_1\.PDF$"),
    ("ПЗ", _ALONE.format("ПЗ")),
    ("ПЗ", r"\bПЗАПИСК|\bПОЯСНИТЕЛЬН\w*[\s._-]+ЗАПИСК"),
    ("ПЗ", r"\bРАЗДЕЛ[_\s-]*(ПД[_\s-]*)?№?1[_\s-]"),
    ("ТЗК", _ALONE.format("ТЗК")),
    ("КАЦ", _ALONE.format("КАЦ?")),
    ("СМ", r"\b(ЛСР|ЛС)(\b|[_-])"),
    ("СМ", r"(РАЗДЕЛ\s*)?12[_\s-]*(ЛС|СМ)"),
    ("ИНЖЕНЕРИЯ", r"ИОСУУ|ХВСУУ|УУГВС|УУХВС"),
    ("ГВС", r"^ПКР-.*" + _ALONE.format("ГВС")),
    ("ИНЖЕНЕРИЯ", r"\b(ГВС|ХВС)\s+ПРОЕКТ\b|\bПРОЕКТ\s+НА\s+УЗЛЫ\s+УЧЕТА\b"),
    ("ИНЖЕНЕРИЯ", r"\bВПВ\b"),
    ("ЭС", r"\bСИСТЕМ\w*\s+ЭЛЕКТРОСНАБЖЕН"),
    ("ОВ", r"\bСИСТЕМ\w*\s+ОТОПЛЕН"),
    ("ИНЖЕНЕРИЯ", r"\bРАЗДЕЛ(\s+ПД)?\s*№?\s*5(\.\d+)?\b"),
    ("АР", r"\bРАЗДЕЛ(\s+ПД)?\s*№?\s*3\b"),
    ("КР", r"\bРАЗДЕЛ(\s+ПД)?\s*№?\s*4\b"),
    ("ПОС", r"^(?=.*(ОРГАНИЗАЦ|ПОКР|ПОС|ПОДПИСАННЫЙ ТИТУЛ)).*\bРАЗДЕЛ(\s+ПД)?\s*№?\s*[67]\b"),
    ("СМ", r"\bРАЗДЕЛ(\s+ПД)?\s*№?\s*12\b"),
    ("ПЗ", r"\bРАЗДЕЛ(\s+ПД)?\s*№?\s*1\s*П?З?\b"),
    ("ПЗ", r"\bРАЗДЕЛ\s*№?\s*1ПЗ\b"),
    ("ИНЖЕНЕРИЯ", r"(?<![0-9A-ZА-ЯЁ])ИОС(?=\d|[^0-9A-ZА-ЯЁ]|$)"),
    ("ИНЖЕНЕРИЯ", _ALONE.format("ЭОМ")),
    ("СМ", r"(?<![0-9A-ZА-ЯЁ])СМЕТ"),
    ("ПОС", _ALONE.format("ПОС|ПОКР")),
    ("ПЗ", _ALONE.format("ПЗ|ПОЯСНИТЕЛЬНАЯ ЗАПИСКА")),
    ("АР", _ALONE.format("АР")),
    ("КР", _ALONE.format("КР")),
    ("ОВ", _ALONE.format("ОВ")),
    ("ВК", _ALONE.format("ВК")),
    ("ЭС", _ALONE.format("ЭС")),
    ("СС", _ALONE.format("СС")),
    ("СМ", _ALONE.format("СМ|СД")),
    ("ИД", _ALONE.format("ИД")),
    ("ФАСАД", _ALONE.format("ФАСАД")),
    ("ФУНДАМЕНТ", _ALONE.format("ФУНДАМЕНТ")),
    ("БАЛКОНЫ", _ALONE.format("БАЛКОН|БАЛКОНЫ")),
    ("ЧЕРДАК", _ALONE.format("ЧЕРДАК")),
    ("КРОВЛЯ", _ALONE.format("КРОВЛ")),
    ("ТЕПЛОВИЗОР", _ALONE.format("ТЕПЛОВИЗ")),
    ("ИНЖЕНЕРИЯ", _ALONE.format("ИОС")),
    ("ПОС", r"ПОКР"),
    ("КР", r"КР\d+(\.PDF)?$"),
    ("ПОС", r"ПРОЕКТ ОРГАНИЗАЦИИ КАПИТАЛЬНОГО РЕМОНТА"),
    ("ИД", r"ИНАЯ ДОКУМЕНТАЦИЯ"),
    ("ПОС", r"^РАЗДЕЛ 7 ПД_"),
]

#: What a lower-cased path may not hold anywhere.
MARKERS = ["иул", "уил", "выпис", "договор", "допсоглаш", "заявлен", "доверен", "ноприз", "сро", "членств", "свидетельств", "нострой", "заключен", "справка гип", "квалификац"]

_DAY = r"\d{1,2}\.\d{1,2}\.\d{4}"
_WORD = r"(?<![0-9a-zа-яё]){}(?![0-9a-zа-яё])"
_REST = r"^(\d+(\.\d+)*[\s._-]*)?"  # a name's number in front may be left out

#: Reasons and what the lower-cased file name is found by, in order.
REASONS = [
    ("договор кчс", rf"^294[67]-к\s+от\s+{_DAY}"),
    ("договор кчс", rf"^(?=.*кчс)\d{{4}}-к\s+от\s+{_DAY}"),
    ("договор субподряда", rf"(?<![0-9a-zа-яё])суб\s+от\s+{_DAY}"),
    ("исходящее", rf"^\d+\s*ис\s+от\s+{_DAY}"),
    ("служебная переписка", r"^(\d+[\s._-]*)?(ответ\s+минстрой|возобновлен)"),
    ("заявление", r"^в\s+гбу([\s._-]|$)"),
    ("ноприз", r"^стройразвитие\s+проект\.*(\.pdf)?$"),
    ("техническое задание", r"^жуковский\b.*\b\d+\.\d+\b"),
    ("решение о смене названия", "[ _]*".join("сменаназвания")),  # spaces and underscores anywhere don't count
    ("обследование", r"(?<![0-9a-zа-яё])обсл([.\s_-]|$)"),
    ("шахматка отказов", r"шахматк"),
    ("технический паспорт мкд", r"технический паспорт мкд"),
    ("технический паспорт мкд", r"^карла маркса 50_08-10-2024_11-49"),
    ("договор по front-matter", r"^(2347псд от 26\.12\.2023\.pdf|2745-к дс 3\.docx\.pdf)$"),
    ("приложение к договору", r"^прил №2 советская 52к3 гвс"),
    ("технический паспорт мкд", _REST + r"паспорт([\s._-]|$)"),
    *[(x, _WORD.format(x)) for x in ("тз", "ао", "дв", "ту")],
    ("ао", r"^ао\d*(\.pdf)?$"),
    ("дв", r"^дв\d*(\.pdf)?$"),
    *[(x, _REST + x + r"([\s._-]|$)") for x in ("тз", "ао", "дв", "ту")],
    ("техническое задание", r"(?<![0-9a-zа-яё])тех[\s._-]*задан"),
    ("тз", r"(?<![0-9a-zа-яё])т[\s._-]*з([\s._-]|$)"),
    ("акт", _REST + r"акт([\s._-]|$)"),
    ("договор", _REST + r"дог([\s._-]|$)"),
    ("допсоглаш", _REST + r"доп([\s._-]|$)"),
    ("письмо", _REST + r"письмо([\s._-]|$)"),
    ("уведомление", _REST + r"уведомление([\s._-]|$)"),
    ("заявка/исходящее", _REST + r"(заяв\w*|зяв\w*|исх)([\s._-]|$)"),
    ("дефектная ведомость", r"дефектн[\w\s._-]*ведомост"),
    ("локальный сметный расчет", r"^(?=.*бим).*(?<![0-9a-zа-яё])лс([._-]|\s)*\d"),
    ("техническое задание", r"(^| )техническое задание|техническое задание "),
    ("акт обслед", r"(^| )акт обслед"),
    ("акт разгранич", r"(^| )акт разгранич"),
    ("дефектная ведомост", r"дефектная ведомост"),
    ("дефектовка", r"дефектовка"),
    ("уведомление", r"(^| )уведомление "),
    ("письмо", r"(^| )письмо "),
]


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def section_of(file_name: Column) -> Column:
    """The section code of a file by its name; UNKNOWN without a rule that fits."""
    return classify(F.upper(file_name), [(code, f"(?U){pattern}") for code, pattern in SECTIONS], "UNKNOWN")


def left_out(path: Column) -> Column:
    """Why a file is left out: a marker anywhere in its path, a rule for its name, or a section that isn't compared; empty if it stays."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    marker = F.when(F.lit(False), "")
    for m in MARKERS:
        marker = marker.when(F.contains(_plain(path), F.lit(m)), m)
    reason = classify(_plain(name), [(label, f"(?U){pattern}") for label, pattern in REASONS], "")
    section = section_of(name)
    by_section = F.when(section.isin("ПЗ", "ТЗК", "КАЦ"), F.lower(section)).otherwise("")
    return F.coalesce(marker, F.nullif(reason, F.lit("")), by_section)
