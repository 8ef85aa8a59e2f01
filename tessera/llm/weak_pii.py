"""Personal data by weak supervision (operator 2), DataFrame functions only.

Regular expressions propose spans of several kinds: those of the four kinds with fixed rules
and, loosely, local phone numbers, national ids, masked mail addresses, account numbers and
names. Six labelers, each with evidence of its own, vote on each span, for, against, or not
at all:

- ``shape``: the exact layout that its kind is written in;
- ``check``: arithmetic on it (check digits, ranges, counts of digits);
- ``gazetteer``: lists (mail domains, dialling codes, card issuers, account countries, titles
  and given names; words that begin sentences);
- ``before`` and ``after``: cue words for and against it, in four languages, on either side;
- ``nearby``: other personal data beside it.

The votes of all spans of all documents are counted by kind and pattern. Expectation-
maximisation over these counts estimates how each labeler votes on true and false spans of a
kind, and how probable each pattern makes a true one; a labeler that doesn't vote says
nothing. With these probabilities as soft labels a logistic span classifier is trained on
the votes and on features of the text that no labeler reads (character shape, length, share
of digits, the characters and words beside the span, hashed). It decides on spans whose kind
has no fixed rule. Spans of the four kinds with fixed rules stay whatever it says, and what
their rules drop only serves as evidence. A loose span that overlaps one of them is dropped
before anything is counted.

The driver gets counts of vote patterns, whose number is fixed by this module, and for the
classifier some ``SAMPLE`` different feature vectors with their counts: all, or beyond that
number the share of them with the smallest hashes. Texts are read once and never shuffled; candidates are written to the shared
folder, where training and labelling read them.

Offsets come from the lengths of the matches and of the pieces between them, so they
are code points, end exclusive. Patterns are possessive and begin where a run begins or
the match before ended, so long texts and runs take linear time.

Edge cases: a null text counts as empty and has no spans; without any candidate no
model is needed and none is trained; equal rows get equal results; columns beside
``doc_id`` and ``text`` are not read; added spans of different kinds may overlap each other.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, stored, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("local_phone", "national_id", "masked_email", "account", "name")
KINDS = BASE_KINDS + ADDED_KINDS

#: Gazetteers. Fixed values.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
GIVEN_NAMES = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth", "David", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Anna", "Peter", "Maria", "José", "Carlos", "Hans", "Jürgen", "Pierre", "Jean", "Sophie")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "eu", "de", "fr", "es", "it", "uk", "us", "ca", "au", "ch", "at", "nl", "be", "mx", "ar", "br", "jp", "cn", "in")
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
IBAN_COUNTRIES = ("AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Words, often capitalised, that are no part of a name.
NO_NAMES = (
    "The", "This", "That", "These", "Those", "And", "But", "For", "With", "From", "Our", "Your", "His", "Her", "Their", "New", "In", "On", "At", "Of", "To", "As", "An", "It", "If", "When",
    "Der", "Die", "Das", "Und", "Ein", "Eine", "Nicht", "Wir", "Sie", "Den", "Dem", "Des", "Mit", "Von", "El", "La", "Los", "Las", "Una", "Un", "De", "Del", "Que", "Y", "En", "Por",
    "Le", "Les", "Une", "Et", "Des", "Du", "Dans", "Sur", "Avec", "Pour", "North", "South", "East", "West", "United", "Street", "Road", "Avenue", "City", "University", "Company", "Group",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December",
)
#: Cue words before a span, and behind it.
_PHONE = ("phone", "call", "tel", "telephone", "mobile", "cell", "fax", "whatsapp", "reach", "ring", "teléfono", "móvil", "llame", "telefon", "handy", "anruf", "rufen", "téléphone", "portable", "appelez")
_MAIL = ("mail", "email", "e-mail", "contact", "write to", "reach", "correo", "escriba", "kontakt", "schreiben", "courriel", "écrivez", "contactez")
BEFORE = {
    "email": _MAIL,
    "ip": ("ip", "host", "server", "address", "login", "from", "servidor", "dirección", "adresse", "rechner", "serveur"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "tarjeta", "carte", "karte", "kreditkarte", "paiement", "pago"),
    "phone": _PHONE,
    "local_phone": _PHONE,
    "national_id": ("ssn", "social security", "national id", "tax id", "dni", "nif", "nie", "identidad", "ausweis", "steuernummer", "sozialversicherung", "sécurité sociale"),
    "masked_email": _MAIL,
    "account": ("iban", "account", "bank", "transfer", "cuenta", "banco", "konto", "überweisung", "compte", "banque", "virement"),
    "name": ("name", "contact", "dear", "signed", "regards", "sincerely", "written by", "author", "by", "nombre", "firmado", "autor", "estimado", "estimada", "atentamente", "liebe", "lieber", "unterzeichnet", "grüßen", "nom", "cher", "chère", "signé", "auteur"),
}
AFTER = {
    "email": ("or", "for details"),
    "ip": ("port", "connected", "logged"),
    "card": ("exp", "expires", "expiry", "cvv", "cvc", "valid"),
    "phone": ("ext", "extension", "mobile", "home", "office"),
    "local_phone": ("ext", "extension", "mobile", "home", "office"),
    "national_id": ("issued", "expires", "expedido"),
    "masked_email": ("or", "for details"),
    "account": ("bic", "swift"),
    "name": ("said", "wrote", "writes", "says", "born", "lives", "aged", "dijo", "nació", "vive", "sagte", "schrieb", "geboren", "wohnt", "dit", "écrit", "né", "née", "habite"),
}
AGAINST_BEFORE = ("version", "order", "orders", "invoice", "isbn", "issn", "sku", "part", "part no", "item", "model", "serial", "build", "chapter", "section", "release", "page", "pages", "figure", "table", "date", "factura", "pedido", "capítulo", "bestellung", "rechnung", "kapitel", "seite", "commande", "facture", "chapitre", "look", "looked", "arrived", "the", "der", "die", "das", "el", "la", "los", "le", "les")
AGAINST_AFTER = ("kg", "km", "mm", "cm", "eur", "usd", "euros", "dollars", "units", "items", "pages", "percent", "inc", "ltd", "gmbh", "corp", "street", "avenue", "river", "mountain", "university", "hotel", "museum", "bank")

_WORD_START, _NO_WORD_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # the chains of digits that have 14 of them or more; others would only be dropped
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![\p{L}\p{N}+.,(/-])(?<![0-9]\x20)(?:\([0-9]{2,5}+\)|[0-9]{2,5}+)(?:[\x20./-]{1,2}+[0-9]{2,5}+){1,4}+(?![\p{L}\p{N}]|[.,/-][0-9])",
    "national_id": r"(?<![\p{L}\p{N}-])(?:[0-9]{3}-?+[0-9]{2}-?+[0-9]{4}|[0-9]{8}-?+[A-Z])(?![\p{L}\p{N}]|-[0-9])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+[(\[{<]?+\x20?+(?:at|AT|arroba)\x20?+[)\]}>]?+\x20?+[A-Za-z0-9-]++\x20?+[(\[{<]?+\x20?+(?:dot|DOT|punto|punkt|point|\.)\x20?+[)\]}>]?+\x20?+[A-Za-z]{2,}+",
    "account": _WORD_START + r"[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3}+)?+" + _NO_WORD_AFTER,
    "name": _WORD_START + r"\p{Lu}\p{Ll}++\.?+(?:\x20\p{Lu}(?:\.|\p{Ll}++)){1,2}+" + _NO_WORD_AFTER,
}
#: A substring without which a text can't match: cheaper than the pattern.
NEEDED = {"email": "@", "phone": "+"}

VOTES = ("shape", "check", "gazetteer", "before", "after", "nearby")
AGAINST_IT, FOR_IT, NO_VOTE = 0, 1, 2
#: Features of the span classifier beside the votes, and how many values each has.
FEATURES = {"kind": len(KINDS), "length": 5, "digits": 4, "left": 3, "right": 3, "form": 32, "word_before": 64, "word_after": 64}
REACH, PART = 40, 256
#: Different feature vectors that the classifier is trained on, as expected by their hashes.
SAMPLE = 20_000


def located(text: Column, kind: str) -> Column:
    """Array of (start, end, match, before, after) of a kind's matches, leftmost and not
    overlapping; ``before`` and ``after`` are the text beside a match, up to the next one.

    Starts are running sums over the matches and the pieces between them, taken within
    parts of ``PART`` matches and then over the parts: a text with very many matches is
    not copied for each of them.
    """
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    sides = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.slice(pieces, F.lit(2), F.size(found)), lambda gap, then: F.struct(F.length(gap).alias("gap"), F.right(gap, F.lit(REACH)).alias("before"), F.left(then, F.lit(REACH)).alias("after")))
    both = F.zip_with(found, sides, lambda m, side: F.struct(m.alias("m"), side.alias("side")))
    kept = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    none = F.array().cast(kept)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["side"]["gap"]
        end = start + F.length(x["m"])
        row = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), x["side"]["before"].alias("before"), x["side"]["after"].alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], row).alias("out"))

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda r: F.struct((r["start"] + acc["at"]).alias("start"), (r["end"] + acc["at"]).alias("end"), r["match"].alias("match"), r["before"].alias("before"), r["after"].alias("after")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    def whole(all_: Column) -> Column:
        def part(c: Column) -> Column:
            return F.aggregate(F.slice(all_, c * PART + 1, F.lit(PART)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PART).cast("int")), part)
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kept}>").alias("out")), join, lambda acc: F.flatten(acc["out"]))

    # an array of one, so that the matches are found once and not in every part
    once = F.element_at(F.transform(F.array(both), whole), 1)
    there = F.rlike(text, F.lit(pattern))
    if kind in NEEDED:
        there = F.contains(text, F.lit(NEEDED[kind])) & there
    return F.when(there, once).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    """For it where ``yes``; against it where ``no`` (None: wherever not ``yes``)."""
    if no is None:
        return F.when(yes, FOR_IT).otherwise(AGAINST_IT)
    return F.when(yes, FOR_IT).when(no, AGAINST_IT).otherwise(NO_VOTE)


#: Layouts that each kind is written in.
SHAPES = {
    "email": r"^[A-Za-z0-9]+(?:[._%+-][A-Za-z0-9]+)*@(?:[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*\.)+[A-Za-z]+$",
    "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$",
    "card": r"^(?:[0-9]+|(?:[0-9]{4}\x20){3}[0-9]{1,7}|(?:[0-9]{4}-){3}[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5})$",
    "phone": r"^\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{1,4}\))?(?:[\x20.-]?[0-9]{2,5}){2,5}$",
    "local_phone": r"^(?:\([0-9]{3}\)\x20?[0-9]{3}[.\x20-][0-9]{4}|[0-9]{3}([.\x20-])[0-9]{3}\1[0-9]{4}|\(?0[0-9]{1,4}\)?[\x20/-]{1,2}[0-9]{2,5}(?:[\x20-][0-9]{2,5}){0,3}|[69][0-9]{2}(?:\x20[0-9]{3}){2}|0[0-9](?:[\x20.][0-9]{2}){4})$",
    "national_id": r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z])$",
    "masked_email": r"[(\[{<]\x20?(?:at|AT|arroba)\x20?[)\]}>].*[(\[{<]\x20?(?:dot|DOT|punto|punkt|point)\x20?[)\]}>]",
    "account": r"^[A-Z]{2}[0-9]{2}(?:[0-9A-Z]+|(?:\x20[0-9A-Z]{4})+(?:\x20[0-9A-Z]{1,3})?)$",
    "name": r"^(?!(\p{L}+)\x20\1)(?:(?:" + "|".join(TITLES) + r")\.|\p{Lu}\p{Ll}{1,11})(?:\x20\p{Lu}(?:\.|\p{Ll}{1,14})){1,2}$",
}


def _fixed_rule(kind: str, match: Column) -> Column:
    """Whether the fixed rule of a base kind keeps a match."""
    n = F.length(_digits(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # leading zeros don't count; what is left has three digits at most, or is too large
        return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.right(p, F.lit(3)).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(match))).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(False)


def mod97(account: Column) -> Column:
    """Whether the check digits of an account number are right."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _check(kind: str, match: Column, base: Column) -> Column:
    """Arithmetic: check digits, ranges, counts."""
    n = F.length(_digits(match))
    if kind == "email":
        return _vote((F.length(match) <= 254) & (F.length(F.substring_index(match, "@", 1)) <= 64))
    if kind in BASE_KINDS:
        return _vote(base)
    if kind == "local_phone":
        date = F.rlike(match, F.lit(r"^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)?[0-9]{2}$|^(?:19|20)[0-9]{2}[./-](?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|[12][0-9]|3[01])$|^(?:1[0-9]|20)[0-9]{2}\x20?[./-]\x20?(?:1[0-9]|20)?[0-9]{2}$"))
        return _vote(F.lit(False), (n < 9) | (n > 12) | date)  # a right count says little
    if kind == "national_id":
        letter = F.substring(F.lit(DNI_LETTERS), F.left(match, F.lit(8)).try_cast("int") % 23 + 1, F.lit(1))
        social = ~F.rlike(match, F.lit("^(?:000|666|9)|^[0-9]{3}-?00|0000$"))
        return _vote(F.when(F.rlike(match, F.lit("[A-Z]$")), F.right(match, F.lit(1)) == letter).otherwise(social))
    if kind == "account":
        return _vote(mod97(match))
    return F.lit(NO_VOTE)


def _gazetteer(kind: str, match: Column) -> Column:
    if kind in ("email", "masked_email"):
        return _vote(F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS))
    if kind == "ip":
        return _vote(F.lit(False), F.rlike(match, F.lit(r"^(0|10|127|255|192\.168|169\.254)\.")))
    if kind == "card":
        return _vote(F.rlike(match, F.lit("^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)")))
    if kind == "phone":
        return _vote(F.regexp_extract(match, r"^\+(1|7|[0-9][0-9]?)", 1).isin(*DIAL_CODES))
    if kind == "account":
        return _vote(F.left(match, F.lit(2)).isin(*IBAN_COUNTRIES))
    if kind == "name":
        listed = F.rlike(match, F.lit(r"\b(?:" + "|".join(GIVEN_NAMES) + r")\b|^(?:" + "|".join(TITLES) + r")\b"))
        return _vote(listed, F.rlike(match, F.lit(r"\b(?:" + "|".join(NO_NAMES) + r")\b")))
    return F.lit(NO_VOTE)


def _cues(side: Column, words: tuple[str, ...], against: tuple[str, ...], where: str) -> Column:
    """For it if a word for the kind is within reach; against it if not, and a word against
    it stands right beside the span."""
    start, end = (r"(?<![\p{L}])(?:", r")(?![\p{L}])")
    beside = r"[^\p{L}]{0,4}$" if where == "before" else ""
    first = "" if where == "before" else r"^[^\p{L}]{0,4}"
    return _vote(F.rlike(side, F.lit(start + "|".join(words) + end)), F.rlike(side, F.lit(first + start + "|".join(against) + end + beside)))


def _side(char: Column) -> Column:
    """0: none or white space, 1: punctuation, 2: a letter or digit."""
    return F.when((char == "") | F.rlike(char, F.lit(r"\s")), 0).when(F.rlike(char, F.lit(r"[\p{L}\p{N}]")), 2).otherwise(1)


def _hashed(text: Column, values: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(values)).cast("int")


def _form(match: Column) -> Column:
    """The match with one sign for each run of digits, capitals and other letters."""
    for run, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"[0-9]{5,}", "00000"), (r"[0-9]", "0")):
        match = F.regexp_replace(match, run, sign)
    return match


def labelers(kind: str, match: Column, before: Column, after: Column, base: Column) -> dict[str, Column]:
    """The vote of each labeler; ``before`` and ``after`` in lower case."""
    others = r"@[a-z0-9-]+\.|(?:^|[^0-9])\+[0-9]{2}" if kind not in ("email", "masked_email") else r"\+?[0-9][0-9()\x20.-]{7,}[0-9]"
    return {
        "shape": _vote(F.rlike(match, F.lit(SHAPES[kind]))),
        "check": _check(kind, match, base),
        "gazetteer": _gazetteer(kind, match),
        "before": _cues(before, BEFORE[kind], AGAINST_BEFORE, "before"),
        "after": _cues(after, AFTER[kind], AGAINST_AFTER, "after"),
        "nearby": _vote(F.rlike(before, F.lit(others)) | F.rlike(after, F.lit(others)), F.lit(False)),
    }


def candidates(text: Column, kinds: tuple[str, ...]) -> Column:
    """Array of the candidates of some kinds, with votes and features."""
    out = []
    for kind in kinds:

        def judged(m: Column) -> Column:  # called before the next kind
            match, start, end = m["match"], m["start"], m["end"]
            base = _fixed_rule(kind, match)
            before, after = F.lower(m["before"]), F.lower(m["after"])
            n, digits = F.length(match), F.length(_digits(match))
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), base.alias("base"),
                *[v.alias(k) for k, v in labelers(kind, match, before, after, base).items()],
                F.when(n <= 8, 0).when(n <= 12, 1).when(n <= 16, 2).when(n <= 24, 3).otherwise(4).alias("length"),
                F.when(digits == 0, 0).when(digits * 2 < n, 1).when(digits < n, 2).otherwise(3).alias("digits"),
                _side(F.right(m["before"], F.lit(1))).alias("left"), _side(F.left(m["after"], F.lit(1))).alias("right"),
                _hashed(_form(match), FEATURES["form"]).alias("form"),
                _hashed(F.regexp_extract(before, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1), FEATURES["word_before"]).alias("word_before"),
                _hashed(F.regexp_extract(after, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1), FEATURES["word_after"]).alias("word_after"),
            )

        out.append(F.transform(located(text, kind), judged))
    return F.concat(*out)


# --- the models, from counts ----------------------------------------------------------

#: Before anything is seen: how probable a true span is, by kind, and how many votes the
#: belief weighs that a labeler is right four times of five.
PRIOR = {k: 0.5 if kind in BASE_KINDS else 0.1 if kind == "name" else 0.2 for k, kind in enumerate(KINDS)}
BELIEF = 20.0


@dataclass(frozen=True)
class Reliability:
    """prior[kind] of a true span; given[kind][y][labeler]: how often it votes for a span,
    true (1) or not (0), if it votes."""

    prior: dict[int, float]
    given: dict[int, list[list[float]]]

    def true(self, kind: int, votes: tuple[int, ...]) -> float:
        t, f = math.log(self.prior[kind]), math.log(1 - self.prior[kind])
        for j, v in enumerate(votes):
            if v != NO_VOTE:
                yes, no = self.given[kind][1][j], self.given[kind][0][j]
                t, f = t + math.log(yes if v == FOR_IT else 1 - yes), f + math.log(no if v == FOR_IT else 1 - no)
        return 1 / (1 + math.exp(min(max(f - t, -60), 60)))


def estimate(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 100) -> Reliability:
    """Expectation-maximisation over counts of (kind, votes)."""
    kinds = {k for k, _ in counts}
    model = Reliability({k: PRIOR[k] for k in kinds}, {k: [[0.2] * len(VOTES), [0.8] * len(VOTES)] for k in kinds})
    for _ in range(rounds):
        true = {k: [BELIEF * PRIOR[k], BELIEF] for k in kinds}
        yes = {k: [[0.2 * BELIEF] * len(VOTES), [0.8 * BELIEF] * len(VOTES)] for k in kinds}
        cast = {k: [[BELIEF] * len(VOTES), [BELIEF] * len(VOTES)] for k in kinds}
        for (kind, votes), n in counts.items():
            p = model.true(kind, votes)
            true[kind][0] += n * p
            true[kind][1] += n
            for j, v in enumerate(votes):
                if v != NO_VOTE:
                    for y, w in ((0, n * (1 - p)), (1, n * p)):
                        cast[kind][y][j] += w
                        yes[kind][y][j] += w * (v == FOR_IT)
        model = Reliability({k: t / n for k, (t, n) in true.items()}, {k: [[a / b for a, b in zip(yes[k][y], cast[k][y], strict=True)] for y in (0, 1)] for k in kinds})
    return model


def _slots() -> dict[str, tuple[int, int]]:
    """Of each feature, where its weights begin and how many there are; a vote has weights
    for each kind."""
    out, at = {}, 1
    for f, size in (FEATURES | {v: 3 * len(KINDS) for v in VOTES}).items():
        out[f] = at, size
        at += size
    return out


SLOTS = _slots()
INPUTS = (*FEATURES, *VOTES)


def classify(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, l2: float = 0.5) -> np.ndarray:
    """Logistic regression on one-hot features: (values as in ``INPUTS``, weight of true,
    weight of false). Weights begin with the intercept."""
    at = np.array([[0, *(SLOTS[f][0] + (v if f in FEATURES else 3 * values[0] + v) for f, v in zip(INPUTS, values, strict=True))] for values, _, _ in rows])
    true, both = np.array([t for _, t, _ in rows]), np.array([t + f for _, t, f in rows])
    size = 1 + sum(n for _, n in SLOTS.values())
    w, moment = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -60, 60)))
        step = (np.bincount(at.ravel(), np.repeat(p * both - true, at.shape[1]), size) + l2 * w) / both.sum()
        moment += step * step
        w -= 0.3 * step / (np.sqrt(moment) + 1e-9)
    return w


def train(found: DataFrame, sample: int = SAMPLE) -> tuple[Reliability | None, np.ndarray | None]:
    """Both models from the candidates of all documents (column ``cands``)."""
    spans = found.select(F.explode("cands").alias("c")).select("c.*")
    by_votes = spans.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).collect()
    if not by_votes:
        return None, None
    model = estimate({(r["kind"], tuple(r[v] for v in VOTES)): r["n"] for r in by_votes})
    vectors = stored(spans.groupBy(*INPUTS).agg(F.count("*").alias("n")), "pii-vectors")
    many = vectors.count()
    if many > sample:  # by hash, so that no task and not the driver has to order them
        vectors = vectors.filter(F.pmod(F.xxhash64(*INPUTS), F.lit(1 << 40)) < int(sample / many * (1 << 40)))
    rows = []
    for r in sorted(vectors.collect()):
        p = model.true(r["kind"], tuple(r[v] for v in VOTES))
        rows.append((tuple(r[f] for f in INPUTS), r["n"] * p, r["n"] * (1 - p)))
    return model, classify(rows)


def accepted(c: Column, weights: np.ndarray, threshold: float) -> Column:
    """Whether the classifier takes a candidate that no fixed rule keeps."""
    z = F.lit(float(weights[0]))
    for f, (at, size) in SLOTS.items():
        value = c[f] if f in FEATURES else 3 * c["kind"] + c[f]
        z = z + F.array(*[F.lit(float(x)) for x in weights[at : at + size]])[value]
    return z >= math.log(threshold / (1 - threshold))


def personal_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans: array of (start, kind number, end, base), by start, then kind."""
    text = text_or_empty()
    found = docs.select("doc_id", candidates(text, BASE_KINDS).alias("__known"), candidates(text, ADDED_KINDS).alias("__loose"))
    found = found.withColumn("__base", F.filter("__known", lambda c: c["base"]))
    apart = F.filter("__loose", lambda c: ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = stored(found.select("doc_id", F.concat("__known", apart).alias("cands")), "pii-candidates")
    _, weights = train(found)
    if weights is None:
        weights = np.zeros(1 + sum(n for _, n in SLOTS.values()))
    chosen = F.filter("cands", lambda c: c["base"] | ((c["kind"] >= len(BASE_KINDS)) & accepted(c, weights, threshold)))
    slim = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base")))
    return found.select("doc_id", F.array_sort(slim).alias("spans"))


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(documents(spark, sf_dir))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def counted(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(counted, range(len(BASE_KINDS)))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
