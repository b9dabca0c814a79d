"""Stems of Russian and English words by the published Snowball algorithms, and lexemes of texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

def by_size(*endings: Iterable[str]) -> dict[int, frozenset[str]]:
    """Endings by their length, longest first."""
    every = set().union(*endings)
    return {n: frozenset(e for e in every if len(e) == n) for n in sorted({len(e) for e in every}, reverse=True)}


def _kinds(behind: str, anywhere: str) -> tuple[frozenset[str], dict[int, frozenset[str]]]:
    return frozenset(behind.split()), by_size(behind.split(), anywhere.split())


# Endings, exceptions and stop words of the two algorithms.
RU_VOWELS = frozenset("аеиоуыэюя")
#: Endings that count behind а or я only, and those that count anywhere.
RU_GERUND = _kinds("в вши вшись", "ив ивши ившись ыв ывши ывшись")
RU_REFLEXIVE = _kinds("", "ся сь")
RU_ADJECTIVE = _kinds("", "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
RU_PARTICIPLE = _kinds("ем нн вш ющ щ", "ивш ывш ующ")
RU_VERB = _kinds(
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно",
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю",
)
RU_NOUN = _kinds("", "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")
RU_SUPERLATIVE, RU_NESS, RU_AND, RU_NN, RU_SOFT = by_size(["ейш", "ейше"]), by_size(["ост", "ость"]), by_size(["и"]), by_size(["нн"]), by_size(["ь"])
RU_STOP = frozenset(
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь "
    "когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо "
    "ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом "
    "один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про "
    "всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между".split()
)
EN_VOWELS = frozenset("aeiouy")
EN_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_WHOLE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
EN_REGION = re.compile("gener|commun|arsen")
EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
EN_PLURAL, EN_PAST = by_size("sses ied ies us ss s".split()), by_size("eed eedly ed edly ing ingly".split())
EN_ENDS2, EN_ENDS3, EN_ENDS4 = by_size(EN_STEP2), by_size(EN_STEP3), by_size(EN_STEP4)
EN_STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now".split()
)
EN_VOWEL, EN_SYLLABLE, RU_SYLLABLE = (re.compile(p) for p in ("[aeiouy]", "[aeiouy][^aeiouy]", "[аеиоуыэюя][^аеиоуыэюя]"))
TOKEN = re.compile(r"\d+(?:\.\d+)+|[^\W_]+")


def regions(word: str, syllable: re.Pattern, start: int = 0) -> int:
    """Where the part behind the first vowel and non-vowel after ``start`` begins."""
    found = syllable.search(word, start)
    return found.end() if found else len(word)


def longest(word: str, endings: dict[int, frozenset[str]], start: int) -> str:
    """The longest of ``endings`` that ``word`` has wholly behind ``start``."""
    most = len(word) - start
    for n, held in endings.items():
        if n <= most and word[-n:] in held:
            return word[-n:]
    return ""


def _without(word: str, endings: tuple[frozenset[str], dict[int, frozenset[str]]], start: int) -> str | None:
    """``word`` without its longest ending; None where it has none, or one that must follow а or я and does not."""
    behind, every = endings
    found = longest(word, every, start)
    left = word[: len(word) - len(found)]
    if not found or found in behind and not (len(left) > start and left[-1] in "ая"):
        return None
    return left


def russian(word: str) -> str:
    """Stem of a lower-case Russian word."""
    word = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(word) if c in RU_VOWELS), len(word))
    r2 = regions(word, RU_SYLLABLE, regions(word, RU_SYLLABLE))
    left = _without(word, RU_GERUND, rv)
    if left is None:
        word = _without(word, RU_REFLEXIVE, rv) or word
        left = _without(word, RU_ADJECTIVE, rv)
        if left is not None:
            left = _without(left, RU_PARTICIPLE, rv) or left
        else:
            left = next((w for w in (_without(word, e, rv) for e in (RU_VERB, RU_NOUN)) if w is not None), word)
    word = left
    if longest(word, RU_AND, rv):
        word = word[:-1]
    if ending := longest(word, RU_NESS, max(r2, rv)):
        word = word[: -len(ending)]
    if ending := longest(word, RU_SUPERLATIVE, rv):
        word = word[: -len(ending)]
    if longest(word, RU_NN, rv) or not ending and longest(word, RU_SOFT, rv):
        word = word[:-1]
    return word


def _short_end(word: str) -> bool:
    """Ends in a short syllable."""
    if len(word) == 2:
        return word[0] in EN_VOWELS and word[1] not in EN_VOWELS
    return len(word) > 2 and word[-1] not in EN_VOWELS | set("wxY") and word[-2] in EN_VOWELS and word[-3] not in EN_VOWELS


def english(word: str) -> str:
    """Stem of a lower-case English word without apostrophes."""
    if len(word) < 3:
        return word
    if word in EN_IRREGULAR:
        return EN_IRREGULAR[word]
    # y at the beginning and behind a vowel is a consonant
    if "y" in word:
        letters = list(word)
        for i, c in enumerate(letters):
            if c == "y" and (i == 0 or letters[i - 1] in EN_VOWELS):
                letters[i] = "Y"
        word = "".join(letters)
    head = EN_REGION.match(word)
    r1 = head.end() if head else regions(word, EN_SYLLABLE)
    r2 = regions(word, EN_SYLLABLE, r1)
    vowel = EN_VOWEL.search

    ending = longest(word, EN_PLURAL, 0)
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and vowel(word[:-2]):
        word = word[:-1]
    if word in EN_WHOLE:
        return word

    ending = longest(word, EN_PAST, 0)
    left = word[: len(word) - len(ending)]
    if ending in ("eed", "eedly"):
        word = left + "ee" if len(left) >= r1 else word
    elif ending and vowel(left):
        word = left
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in EN_VOWELS:
        word = word[:-1] + "i"

    ending = longest(word, EN_ENDS2, 0)
    left = word[: len(word) - len(ending)]
    fits = {"ogi": left.endswith("l"), "li": left[-1:] in set("cdeghkmnrt")}.get(ending, True)
    if ending and len(left) >= r1 and fits:
        word = left + EN_STEP2[ending]
    ending = longest(word, EN_ENDS3, 0)
    left = word[: len(word) - len(ending)]
    if ending and len(left) >= (max(r1, r2) if ending == "ative" else r1):
        word = left + EN_STEP3[ending]
    ending = longest(word, EN_ENDS4, 0)
    left = word[: len(word) - len(ending)]
    if ending and len(left) >= r2 and (ending != "ion" or left[-1:] in ("s", "t")):
        word = left
    left = word[:-1]
    if word.endswith("e") and (len(left) >= r2 or len(left) >= r1 and not _short_end(left)) or word.endswith("ll") and len(left) >= r2:
        word = left
    return word.replace("Y", "y")


@lru_cache(maxsize=1 << 19)
def lexeme(token: str) -> str | None:
    """What a lower-case token is found by: its stem if it is Russian or ASCII letters, else itself; None for stop words."""
    if token in RU_STOP or token in EN_STOP:
        return None
    if token.isascii():
        return english(token) if token.isalpha() else token
    return russian(token) if all("а" <= c <= "я" or c == "ё" for c in token) else token


def lexemes(text: str) -> Iterator[tuple[int, str]]:
    """(position, lexeme) of a text's words; stop words have a place and no lexeme. Numbers with dots stay whole."""
    for i, token in enumerate(TOKEN.findall(text.lower()), 1):
        if (found := lexeme(token)) is not None:
            yield i, found
