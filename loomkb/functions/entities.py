"""Entities of a text by patterns: versions, own objects, documents, servers, metadata objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and names that define the results.
B, E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
PLATFORM = B + r"(8\.[35]\.\d{1,2}\.\d{3,5})" + E
PRODUCT = r"(?iu)" + B + r"(УТ|УПП|ERP|КА|БП|ЗУП|УНФ)\s*(\d{1,2}(?:\.\d{1,3}){1,3})" + E
OWN_OBJECT = B + r"(КС_[A-Za-zА-Яа-яЁё0-9_]+)"
OWN_QUOTED = r"""[«"]([^«»"]{2,80}\(КС\))[»"]"""
AGREEMENT = r"(?iu)" + B + r"(?:ДС|доп[\p{L}\p{N}_]*\.?\s*соглашени[\p{L}\p{N}_]*)\s*№\s*(\d+)"
TASK = r"(?iu)" + B + r"ТЗ(?:\s*ред\.?\s*(\d+))?" + E
PROGRAMME = r"(?iu)" + B + r"(ПиМИ|ПМИ)" + E
SERVER = r"(?i)\b([a-z][a-z0-9-]{2,}(?:app|srv|sql|db|web|ras|apl)[0-9]{1,3})\b"
DOTTED = (
    B + r"((?:Справочник|Документ|РегистрСведений|РегистрНакопления|РегистрБухгалтерии|Обработка|Отчет|ОбщийМодуль|Перечисление|"
    r"ПланВидовХарактеристик|БизнесПроцесс|Задача|ЖурналДокументов)\.[A-Za-zА-ЯЁа-яё0-9_]+)"
)
IDENTIFIER = B + r"(КС_[\p{L}\p{N}_]+|[А-ЯЁ][а-яё]{2,}(?:[А-ЯЁ][а-яё]{2,}|[А-ЯЁ]{2,}" + E + r")+)"
MODULES = "МодульОбъекта МодульМенеджера МодульФормы МодульНабораЗаписей Форма ФормаОбъекта ФормаСписка МодульКоманды".split()


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _named(kind: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), F.concat(F.lit(kind + ":"), F.lower(n)).alias("key")))


def entities(text: Column) -> Column:
    """Distinct (kind, name, key) of a text, kind by kind."""
    versions = F.transform(_all(text, PLATFORM), lambda v: F.concat(F.lit("Платформа "), v))
    products = F.transform(F.arrays_zip(_all(text, PRODUCT, 1).alias("p"), _all(text, PRODUCT, 2).alias("v")), lambda x: F.concat(F.upper(x["p"]), F.lit(" "), x["v"]))
    own = F.concat(_all(text, OWN_OBJECT), _all(text, OWN_QUOTED))
    agreements = F.transform(_all(text, AGREEMENT), lambda n: F.concat(F.lit("ДС № "), n))
    tasks = F.transform(_all(text, TASK), lambda n: F.when(F.coalesce(n, F.lit("")) == "", F.lit("ТЗ")).otherwise(F.concat(F.lit("ТЗ ред. "), n)))
    programme = F.transform(_all(text, PROGRAMME), lambda _: F.lit("ПиМИ"))
    servers = F.transform(_all(text, SERVER), lambda s: F.lower(s))
    return F.array_distinct(
        F.concat(
            _named("software_version", F.concat(versions, products)),
            _named("md_object", own),
            _named("document", F.concat(agreements, tasks, programme)),
            _named("server", servers),
        )
    )


def metadata_objects(text: Column) -> Column:
    """``Kind.Name`` references and free identifiers, each once; names of modules are none."""
    dotted = _all(text, DOTTED)
    named = F.transform(dotted, lambda d: F.substring_index(d, ".", -1))
    modules = F.array(*[F.lit(m) for m in MODULES])
    free = F.filter(_all(text, IDENTIFIER), lambda i: ~F.array_contains(modules, i) & ~F.array_contains(named, i))
    return F.array_distinct(F.concat(dotted, free))


def source_label(attrs: Column, text: Column) -> Column:
    """A readable citation of a chunk from its attributes."""
    a = lambda k: F.nullif(F.try_element_at(attrs, F.lit(k)), F.lit(""))
    title = F.coalesce(a("title"), F.left(F.substring_index(text, "\n", 1), F.lit(120)))
    mail = F.concat_ws(", ", F.concat(F.lit("письмо «"), F.regexp_replace(title, "^Тема: ", ""), F.lit("»")), a("date"), a("author"))
    place = F.coalesce(
        F.concat(F.lit(", тест-кейс № "), a("test_case")), F.concat(F.lit(", пункт плана № "), a("plan_item")), F.concat(F.lit(", раздел "), a("section")), F.lit("")
    )
    document = F.concat(
        F.coalesce(a("doc_title"), title),
        F.coalesce(F.concat(F.lit(" (ред. "), a("doc_version"), F.lit(")")), F.lit("")),
        place,
        F.coalesce(F.concat(F.lit(", комментарий "), a("comment_author")), F.lit("")),
        F.coalesce(F.concat(F.lit(" ["), a("received"), F.lit("]")), F.lit("")),
    )
    return F.when(a("doc_type") == "email", mail).otherwise(document)
