"""Text cleaning, identity and extraction as column expressions.

Everything here stays inside whole-stage code generation; patterns write the
letter class as ``[\\p{L}\\p{N}_]`` and fold case with ``(?iu)``, so that they
mean the same for every script.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"

# Patterns that define the results.
BANNER = r"(?imu)^\s*(External mail\s*:.*|\[?EXTERNAL\]?.*|ВНЕШНЕЕ ПИСЬМО.*|Внимание! Письмо от внешнего отправителя.*)\s*$"
SIGNATURE = (
    r"(?imu)^\s*(--\s*$|С уважением(?![\p{L}\p{N}_])|С наилучшими пожеланиями(?![\p{L}\p{N}_])|Best regards\b|Kind regards\b|Regards,?\s*$|"
    r"Cordialement\b|Спасибо[.!,]?\s*$|Thanks[.!,]?\s*$|Thank you[.!,]?\s*$)"
)
DISCLAIMER = (
    r"(?imu)^\s*(Conformément à la Charte|In accordance with the .{0,60}Charter|Avis\s*:|Notice\s*:|Disclaimer\s*:|"
    r"Данное сообщение (и любые|является|содержит)|Это (сообщение|письмо) (и любые|может содержать|содержит)|"
    r"This (e-?mail|message) (and any|is confidential|may contain|contains))"
)
DISCLAIMER_PAIRS = (("конфиденциальн", "получател"), ("confidential", "recipient"), ("intended", "recipient"), ("this e-mail", "disclose"))
EMAIL = r"[\p{L}\p{N}_.+-]+@([\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+)"
PHONE = r"(?iu)(?<!\d)(?:\+7|8)[\s(-]*\d{3}[\s)-]*\d{3}[\s-]*\d{2}[\s-]*\d{2}(?!\d)(?:\s*(?:#|доб\.?)\s*\d+)?"
PHONE_TOKEN = "<телефон>"
REPLY_PREFIX = r"^(?iu)(\s*(re|fw|fwd|ответ|пересл|rv|tr|aw|wg)\s*(\[\d+\])?\s*:\s*)+"
IMPORTANCE = r"(?imu)^[ \t>]*(?:Importance|Важность|Priority|Приоритет)\s*:\s*[\p{L}\p{N}_]+[ \t]*\n?"
DOC_TYPES = (
    ("pimi", r"программ[\p{L}\p{N}_]*\s+и\s+методик[\p{L}\p{N}_]*\s+испытан|(^|[^а-яё])п(и)?ми([^а-яё]|$)"),
    ("ds", r"дополнительн[\p{L}\p{N}_]*\s+соглашени|(^|[^а-яё])дс\s*№?\s*\d"),
    ("tz", r"техническ[\p{L}\p{N}_]*\s+задани|(^|[^а-яё])тз([^а-яё]|$)"),
)
DOC_KINDS = (
    *DOC_TYPES,
    ("requirements", r"бизнес[\s-]*требован|функциональн[\p{L}\p{N}_]*\s+требован|(^|[^а-яё])бт([^а-яё]|$)|правила\s+и\s+ограничени"),
    ("process", r"as[\s_-]*is|to[\s_-]*be|описани[\p{L}\p{N}_]*\s+(бизнес[\s-]*)?процесс|(^|[^а-яё])бп\s+as|схем[\p{L}\p{N}_]*\s+процесс"),
    ("protocol", r"протокол|решени[\p{L}\p{N}_]*\s+совещани|итоги\s+встреч"),
    ("instruction", r"инструкци|руководств[\p{L}\p{N}_]*\s+пользовател|регламент"),
    ("report", r"отч[её]т|выгрузк|реестр|оборотн"),
)
#: What every match of a rule holds: words, looked for before its pattern is tried, or a plainer pattern.
DOC_SIGNS = {
    "pimi": ("программ", "пми", "пими"),
    "ds": ("дополнительн", "дс"),
    "tz": ("техническ", "тз"),
    "requirements": ("требован", "бт", "правила"),
    "process": r"as[\s_-]*is|to[\s_-]*be|процесс|бп",
    "protocol": ("протокол", "совещани", "итоги"),
    "instruction": ("инструкци", "руководств", "регламент"),
    "report": ("отчет", "отчёт", "выгрузк", "реестр", "оборотн"),
}
DOC_VERSION = r"(?iu)(?:верси[яи]\s+документа|ред\.?|редакци[яи]|ver\.?|версия)\s*(\d+(?:\.\d+)?)"
TITLE_STOP = (
    "и в на по с для о об к из от до ред редакция версия ver v docx doc pdf xlsx final итог итоговая новая копия copy".split()
)
STEM_STOP = (
    "после перед когда который которые также этого этот через будет можно нужно добрый день коллеги пожалуйста спасибо уважением "
    "ошибка ошибки просьба прошу проверить проверка работа работает данные данных форма формы система системе программа результат "
    "критерий методика".split()
)
OBJECT_KIND = (
    r"(?iu)^\s*(?:Справочник|Документ|РегистрСведений|РегистрНакопления|РегистрБухгалтерии|Обработка|Отчет|Отчёт|ОбщийМодуль|Перечисление|"
    r"ПланВидовХарактеристик|БизнесПроцесс|Задача|ЖурналДокументов|регистр[\p{L}\p{N}_]*\s+[\p{L}\p{N}_]+|справочник[\p{L}\p{N}_]*|"
    r"документ[\p{L}\p{N}_]*|обработк[\p{L}\p{N}_]*|отч[её]т[\p{L}\p{N}_]*)[.\s]*"
)
NUMBER_REFS = (
    ("test_case", r"(?iu)тест[-\s]?кейс[\p{L}\p{N}_]*\s*(?:№\s*)?(\d{1,4})"),
    ("plan_item", r"(?iu)(?:пункт[\p{L}\p{N}_]*|п\.)\s*(?:№\s*)?(\d{1,4})\s*(?:плана|пл\.)"),
    ("plan_item", r"(?iu)(?:пункт[\p{L}\p{N}_]*|п\.)\s*(?:плана\s*(?:тестирования)?\s*)?(?:№\s*)?(\d{1,4})(?![\p{L}\p{N}_])"),
)
TICKETS = (
    r"(?<![\p{L}\p{N}_.])(\d{7,12})(?![\p{L}\p{N}_.])",
    r"(?iu)(?<![\p{L}\p{N}_])((?:INC|SR|REQ|RITM|CHG|TASK|SD)[-_]?\d{4,10})(?![\p{L}\p{N}_])",
    r"\[#\s*(\d{3,10})\]",
    r"(?iu)(?:заявк|тикет|инцидент|ticket|request)[\p{L}\p{N}_]*\s*(?:№|N|#|no\.?)?\s*(\d{3,12})(?![\p{L}\p{N}_])",
)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def casefold(text: Column) -> Column:
    """Lower case with ё as е; null counts as empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")


# cleaning


def normalize_whitespace(text: Column) -> Column:
    """Line ends, no-break and zero-width spaces, trailing blanks, at most one empty line in a row."""
    t = F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    t = F.regexp_replace(t, r"[^\S\n]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_banners(text: Column) -> Column:
    return F.regexp_replace(text, BANNER, "")


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with ``value`` computed once, however often ``make`` names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _cut(text: Column, pattern: str, rest: Callable[[Column], Column] = lambda cut: cut) -> Column:
    """``rest`` of what stands before the pattern; texts without it stay as they are."""

    def before(t: Column) -> Column:
        return bind(F.regexp_instr(t, F.lit(pattern)), lambda at: F.when(at > 0, rest(F.substring(t, F.lit(1), at - 1))).otherwise(t))

    return bind(text, before)


def strip_signature(text: Column) -> Column:
    """Everything from the first signature line on goes."""
    return _cut(text, SIGNATURE, lambda cut: F.regexp_replace(cut, r"\s+$", ""))


def strip_disclaimers(text: Column) -> Column:
    """Everything from a disclaimer's start on goes, and paragraphs that read like one."""

    def legal(p: Column) -> Column:
        return bind(F.lower(p), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(a)) & F.contains(low, F.lit(b)) for a, b in DISCLAIMER_PAIRS]))

    paragraphs = F.split(_cut(text, DISCLAIMER), r"\n\s*\n")
    return F.regexp_replace(F.array_join(F.filter(paragraphs, lambda p: ~legal(p)), "\n\n"), r"^\s+|\s+$", "")


def tidy_links(text: Column) -> Column:
    def tidied(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, r"\s*<mailto:[^>]+>\s*", " "), r"\s*<(https?://[^>\s]+)>", "")

    return bind(text, lambda t: F.when(F.contains(t, F.lit("<")), tidied(t)).otherwise(t))


def mask_email(text: Column, keep_domains: tuple[str, ...] = ()) -> Column:
    """Addresses become ``<email@domain>``, the domain in lower case; kept domains stay as they are."""
    # what is masked already stays as it is
    fresh = rf"(?<![\p{{L}}\p{{N}}_.+-])(?!(?<=<)email@[\p{{L}}\p{{N}}_.-]+>)({EMAIL})"

    def shown(part: Column) -> Column:
        address, rest = F.substring_index(part, "\u0002", 1), F.substring_index(part, "\u0002", -1)
        domain = F.lower(F.substring_index(address, "\u0003", -1))
        kept = domain.isin(*keep_domains) if keep_domains else F.lit(False)
        masked = F.when(kept, F.substring_index(address, "\u0003", 1)).otherwise(F.concat(F.lit("<email@"), domain, F.lit(">")))
        return F.when(F.contains(part, F.lit("\u0002")), F.concat(masked, rest)).otherwise(part)

    def masked(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, fresh, "\u0001$1\u0003$2\u0002"), "\u0001")
        return F.when(F.contains(t, F.lit("@")), F.array_join(F.transform(parts, shown), "")).otherwise(t)

    return bind(text, masked)


def mask_pii(text: Column, keep_domains: tuple[str, ...] = ()) -> Column:
    return F.regexp_replace(mask_email(text, keep_domains), PHONE, PHONE_TOKEN)


def unwrap_safelinks(text: Column) -> Column:
    """Gateway links become the address they carry in ``url=``."""
    link = r"(?iu)https?://[\p{L}\p{N}_.-]*safelinks\.protection\.outlook\.com/\S*?[?&]url=([^&\s>)\]]+)[^\s>)\]]*"

    def decoded(part: Column) -> Column:
        link, rest = F.substring_index(part, "\u0002", 1), F.substring_index(part, "\u0002", -1)
        return F.when(F.contains(part, F.lit("\u0002")), F.concat(F.coalesce(F.try_url_decode(link), link), rest)).otherwise(part)

    def unwrapped(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, link, "\u0001$1\u0002"), "\u0001")
        return F.when(F.contains(F.lower(t), F.lit("safelinks.protection.outlook.com")), F.array_join(F.transform(parts, decoded), "")).otherwise(t)

    return bind(text, unwrapped)


def dedent_quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(\t| {4}|>\s?)+", "")


def clean_email_text(text: Column, mask: bool = True) -> Column:
    """The nine cleaning steps of one letter, in their order."""
    t = F.regexp_replace(normalize_whitespace(text), IMPORTANCE, "")
    t = tidy_links(strip_disclaimers(strip_signature(strip_banners(unwrap_safelinks(t)))))
    return normalize_whitespace(mask_pii(t) if mask else t)


def text_safe(text: Column) -> Column:
    """Control characters that no store takes are dropped."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


# identity


def chunk_id(source: Column, title: Column, text: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (source, title, text)]
    return F.left(F.sha1(F.concat_ws("\n", *parts)), F.lit(16))


def entity_key(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(name))


def content_fingerprint(text: Column, title: Column | None = None) -> Column:
    """SHA-1 of letters and digits only; of the title where the text has none."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", "")
    norm = bare(text) if title is None else F.coalesce(F.nullif(bare(text), F.lit("")), bare(title))
    return F.sha1(norm)


def thread_subject(subject: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), REPLY_PREFIX, ""))


def sender_key(name: Column, address: Column) -> Column:
    """First word of the name, or the mailbox where there is no name."""
    first = F.element_at(F.split(F.trim(F.coalesce(name, F.lit(""))), r"[\s,]+"), 1)
    return casefold(F.coalesce(F.nullif(first, F.lit("")), F.substring_index(F.coalesce(address, F.lit("")), "@", 1)))


def split_address(value: Column) -> Column:
    """Struct (name, email) of one address line."""
    email = F.lower(F.regexp_extract(value, EMAIL, 0))
    bare = F.regexp_replace(F.regexp_replace(value, r"[<\[(]\s*(mailto:)?[^>\])]*@[^>\])]*[>\])]", ""), r"<mailto:[^>]*>", "")
    name = F.regexp_replace(bare, r"""^[ \t"'<>;,]+|[ \t"'<>;,]+$""", "")
    mailbox = F.substring_index(email, "@", 1)
    plain = (name == "") | F.contains(name, F.lit("@"))
    return F.struct(F.when(plain & (email != ""), mailbox).otherwise(name).alias("name"), email.alias("email"))


def people(value: Column) -> Column:
    """Recipients as ``Name (domain)``, each once, in their order."""
    parts = F.split(F.regexp_replace(F.coalesce(value, F.lit("")), r"<mailto:[^>]*>", ""), r";|,(?![^<\[]*[>\]])")

    def shown(part: Column) -> Column:
        a = split_address(part)
        domain = F.when(F.contains(a["email"], F.lit("@")), F.substring_index(a["email"], "@", -1)).otherwise(F.lit(""))
        both = F.concat(a["name"], F.lit(" ("), domain, F.lit(")"))
        return F.when((domain != "") & (a["name"] != ""), both).when(a["name"] != "", a["name"]).otherwise(domain)

    return F.array_join(F.array_distinct(F.filter(F.transform(parts, shown), lambda x: x != "")), "; ")


def dedup_keys(name: Column, address: Column, at: Column, body: Column) -> Column:
    """Keys of a letter: who and minute, who and the first 120 letters (20 at least)."""
    who = sender_key(name, address)
    bare = F.left(F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), r"[^\p{L}\p{N}_]+", ""), F.lit(120))
    minute = F.concat(who, F.lit("|"), F.date_format(at, "yyyy-MM-dd HH:mm"))
    return F.array_compact(F.array(minute, F.when(F.length(bare) >= 20, F.concat(who, F.lit("|"), bare))))


def clean_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"^[0-9a-f]{8}-", "")


def safe_filename(name: Column) -> Column:
    base = F.regexp_replace(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1), r'[<>:"|?*\x00-\x1f]+', "_")
    bare = F.regexp_replace(base, r"^[\s.]+|[\s.]+$", "")
    return F.left(F.when(bare == "", F.lit("file")).otherwise(bare), F.lit(150))


# words


def words(text: Column) -> Column:
    return _all(casefold(text), rf"({W}+)")


def shingles(tokens: Column, n: int = 3) -> Column:
    """Distinct n-word strings; the whole sequence where it is shorter, none without words."""
    size = F.size(tokens)
    at = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
    windows = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " ")))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(windows)


def stems(text: Column) -> Column:
    """Distinct 6-letter stems of words of four letters and more, without the stop words."""
    found = _all(F.lower(F.coalesce(text, F.lit(""))), "([a-zа-яё]{4,})")
    stop = F.array(*[F.lit(w) for w in STEM_STOP])
    return F.array_distinct(F.transform(F.filter(found, lambda w: ~F.array_contains(stop, w)), lambda w: F.left(w, F.lit(6))))


def title_stems(title: Column) -> Column:
    found = _all(F.translate(casefold(title), "_", " "), "([a-zа-яё]+)")
    stop = F.array(*[F.lit(w) for w in TITLE_STOP])
    kept = F.filter(found, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))
    return F.array_distinct(F.transform(kept, lambda w: F.left(w, F.lit(6))))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements by the smaller set; 0 where a set is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def set_cosine(a: Column, b: Column) -> Column:
    both = F.size(a).cast("double") * F.size(b)
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / F.sqrt(both)).otherwise(F.lit(0.0))


def object_key(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), OBJECT_KIND, ""), r"(?iu)\s+и\s+", " ")
    return F.regexp_replace(F.lower(bare), "[^a-zа-яё0-9_]", "")


def added_lines(new: Column, old: Column, least: int = 15) -> Column:
    """Lines of ``new`` with at least ``least`` letters that ``old`` does not have."""
    norm = lambda c: F.array_join(words(c), " ")
    known = norm(old)
    lines = F.filter(F.split(new, r"\r?\n"), lambda x: (F.length(norm(x)) >= least) & ~F.contains(known, norm(x)))
    return F.transform(lines, lambda x: F.trim(x))


def eval_norm(text: Column) -> Column:
    t = F.regexp_replace(casefold(text), r"""[«»"'„“”]""", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def first_sentence(text: Column, least: int = 30, limit: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    found = _first(flat, rf"^(.{{{least},}}?[.!?])(\s|$)")
    return F.left(F.coalesce(found, flat), F.lit(limit))


# extraction


def _signed(low: Column, signs: str | tuple[str, ...]) -> Column:
    if isinstance(signs, str):
        return F.regexp_like(low, F.lit(f"(?u){signs}"))
    return reduce(Column.__or__, [F.contains(low, F.lit(s)) for s in signs])


def _ruled(rules: tuple[tuple[str, str], ...], texts: tuple[Column, ...], default: str) -> Column:
    found = []
    for text in texts:
        low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("_"), F.lit(" "))
        kind = F.lit(None).cast("string")
        for name, pattern in reversed(rules):
            kind = F.when(_signed(low, DOC_SIGNS[name]) & F.regexp_like(low, F.lit(f"(?u){pattern}")), F.lit(name)).otherwise(kind)
        found.append(kind)
    return F.coalesce(*found, F.lit(default))


def guess_doc_type(*texts: Column) -> Column:
    return _ruled(DOC_TYPES, texts, "doc")


def guess_kind(*texts: Column) -> Column:
    return _ruled(DOC_KINDS, texts, "other")


def guess_doc_version(*texts: Column) -> Column:
    return F.coalesce(*[_first(t, DOC_VERSION) for t in texts])


def guess_doc_date(*texts: Column) -> Column:
    pattern = r"(?<!\d)(\d{2})[.\-_]?(\d{2})[.\-_]?(20\d{2})(?!\d)"
    parts = [F.concat_ws("-", *[F.regexp_extract(t, pattern, g) for g in (3, 2, 1)]) for t in texts]
    return F.coalesce(*[F.to_date(F.try_to_timestamp(p, F.lit("yyyy-MM-dd"))) for p in parts])


def expand_ranges(text: Column, most: int = 500) -> Column:
    """Numbers of a list with ranges, as strings; too wide and falling ranges are dropped."""

    def numbers(part: Column) -> Column:
        a = F.try_to_number(F.regexp_extract(part, r"^\s*(\d{1,9})\s*[–—-]\s*(\d{1,9})\s*$", 1), F.lit("999999999")).cast("int")
        b = F.try_to_number(F.regexp_extract(part, r"^\s*(\d{1,9})\s*[–—-]\s*(\d{1,9})\s*$", 2), F.lit("999999999")).cast("int")
        fine = (b >= a) & (b - a < most)
        # both ends are guarded: the range is built even where it is not used
        low = F.when(fine, a).otherwise(F.lit(0))
        run = F.transform(F.sequence(low, F.when(fine, b).otherwise(F.lit(0))), lambda i: i.cast("string"))
        single = F.regexp_like(part, F.lit(r"^\s*\d+\s*$"))
        none = F.array().cast("array<string>")
        return F.when(fine, run).when(single, F.array(F.trim(part))).otherwise(none)

    return F.flatten(F.transform(F.split(text, r"[,;]\s*"), numbers))


def number_refs(text: Column) -> Column:
    """Distinct (attr, value) references to test cases and plan items, pattern by pattern."""

    def named(attr: str, pattern: str) -> Column:
        return F.transform(_all(text, pattern), lambda v: F.struct(F.lit(attr).alias("attr"), v.alias("value")))

    return F.array_distinct(F.concat(*[named(attr, pattern) for attr, pattern in NUMBER_REFS]))


def external_refs(*texts: Column) -> Column:
    found = [_all(F.coalesce(t, F.lit("")), p) for t in texts for p in TICKETS]
    return F.array_distinct(F.transform(F.concat(*found), lambda r: F.translate(F.upper(r), "_", "-")))


def mentioned_numbers(text: Column, most: int = 3) -> Column:
    found = _all(text, r"(?iu)(?:ОБР|OBR)\s*-?\s*(\d{1,9})")
    found = F.concat(found, _all(text, r"(?iu)обращени[\p{L}\p{N}_]*\s*(?:№\s*)?(\d{1,9})"))
    return F.slice(F.array_distinct(F.transform(found, lambda n: n.cast("int"))), 1, most)


def issue_number(number: Column) -> Column:
    return F.concat(F.lit("ОБР-"), F.lpad(number.cast("string"), F.greatest(F.length(number.cast("string")), F.lit(4)), F.lit("0")))


def parse_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(?iu)^\s*(?:(?:ОБР|OBR)\s*-?\s*)?0*(\d{1,9})\s*$", 1).try_cast("int")
