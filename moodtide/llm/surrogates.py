"""PII: detected entities are replaced by keyed surrogates of the same type, format, gender and script."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b
from ipaddress import IPv6Address

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.sizing import is_small
from .common import plain_text, written

#: Titles that announce a name, by the gender they tell (fixed values).
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Madam", "госпожа"),
    "u": ("Dr", "Prof"),
}
#: Given and family names by script and gender, the stock that surrogates are drawn from.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Conrad Damian Edgar Felix Gregor Hugo Ivo Julian Konrad Leon Marius Nolan Oscar Pascal Quentin Ruben Simon Tristan".split(),
    ("latin", "f"): "Adele Bianca Clara Delia Elena Flora Greta Helena Irene Julia Karla Lydia Miriam Nadia Olivia Paula Rosa Stella Tilda Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Лев Максим Олег Павел Роман Степан Тимур".split(),
    ("cyrillic", "f"): "Алина Белла Вера Галина Дарья Ева Зоя Инна Клара Лидия Мария Нина Ольга Полина Римма".split(),
}
FAMILY = {
    "latin": "Alder Barlow Castell Dorn Egger Falk Garner Holt Ives Jansen Keller Lorenz Marlow Norden Ortega Pratt Quill Renner Salas Thorne Ulmer Vidal Weston Yates Zeller".split(),
    "cyrillic": "Авдеев Белов Волков Громов Дубов Ершов Жуков Зимин Ильин Козлов Лосев Мохов Носов Орлов Панов".split(),
}
ENDINGS = {"latin": "berg dale ford gate hall ley mann mont ner stein ton wick".split(), "cyrillic": "енко ин ов ский".split()}

#: First and last letters that surrogates of names in other scripts are drawn from, small ones where there are two cases (fixed values).
LETTERS = {
    "greek": "αω", "armenian": "աֆ", "hebrew": "את", "arabic": "ؠي", "devanagari": "कह", "thai": "กฮ", "georgian": "აჰ",
    "hiragana": "あん", "katakana": "アン", "hangul": "가힣", "han": "一龥",
}
_SPELT = [t for all_ in TITLES.values() for t in all_]
_TITLE = "|".join(re.escape(t) for t in dict.fromkeys([*_SPELT, *(t.upper() for t in _SPELT)]))
_NAME = r"[^\W\d_a-zа-яß-öø-ÿ][^\W\d_]*(?:[-'](?!s\b)[^\W\d_]+)*"
_VENDOR = r"(?:AKIA[0-9A-Z]{12,}|gh[opsu]_[0-9A-Za-z]{20,}|sk[-_](?:live[-_]|test[-_])?[0-9A-Za-z]{16,}|xox[abp]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{20,})"
#: What a secret is assigned to, in any case, and how; the value then is long hex or base64 (unquoted with a digit), but no number of a card or an account.
_KEYS = ("token", "key", "secret", "passw", "pwd")
_ASSIGN = r"[A-Za-z0-9_-]{0,20}[\"']?[ \t]*(?:=>|:=|=|:)"
_ASSIGNED = (
    rf"(?P<assigned>(?ai:{'|'.join(_KEYS)}){_ASSIGN}[ \t]*[\"']?)"
    rf"(?P<value>{_VENDOR}|(?!\d{{13,19}}(?![\w-])|[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}(?![\w-]))"
    rf"(?:(?<=[\"'])|(?=[A-Za-z+/_-]*\d))[A-Za-z0-9+/_-]{{16,}}+={{0,2}}(?![\w@]))"
)
_H = r"[0-9A-Fa-f]{1,4}"
#: Addresses with "::" begin with a group that is in use (2000::/3, fc00::/7, fe80::/10, ff00::/8, 64:ff9b::/96, ::ffff:0:0/96), which slices and scopes in code do not.
_SHORT_IPV6 = (
    rf"(?:[23][0-9A-Fa-f]{{3}}|[Ff](?:[CcDdFf][0-9A-Fa-f]|[Ee][89ABab])[0-9A-Fa-f]|64:[Ff][Ff]9[Bb])(?::{_H}){{0,6}}::(?:{_H}(?::{_H}){{0,6}})?(?![\w:]|\.\d)"
    rf"|::[Ff]{{4}}(?::{_H}){{2}}(?![\w:]|\.\d)"
)


def _pattern(assigned: str = "", short_ipv6: str = "") -> re.Pattern:
    return re.compile(
        rf"(?P<email>(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++){{0,16}}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
        rf"|(?P<secret>\b{_VENDOR}){assigned}"
        rf"|(?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)\b)"
        rf"|(?P<ipv4>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w))"
        rf"|(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![\w:]){short_ipv6}))"
        rf"|(?P<card>(?<![\w-])(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}})(?![\w-]))"
        rf"|(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))"
        rf"|(?P<phone>(?<![\w.])(?!\d{{4}}-\d\d-\d\d(?!\d))(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}(?![\w-])|(?<![\w.])\+\d{{8,14}}(?!\w))"
        rf"|(?<!\w)(?P<title>{_TITLE})\.?[ ](?P<name>{_NAME}(?:[ ]{_NAME}){{0,2}})"
    )


#: The second pattern also has what only texts with one of its keys or "::" can hold, which is quickly seen.
_PATTERN, _WIDE = _pattern(), _pattern(f"|{_ASSIGNED}", f"|{_SHORT_IPV6}")
_GENDER = {spelt: gender for gender, titles in TITLES.items() for title in titles for spelt in (title, title.upper())}
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:[-'][^\W\d_]+)*(?!\w)")
#: About how many entities of a full pool exchange their values in one circle.
CIRCLE = 10_000


def may_hold(text: Column) -> Column:
    """False only for texts in which ``entities`` finds nothing; Spark asks this before Python sees a text.

    Each pattern starts with one class of characters that are seldom met, so that a search is one test per character.
    """
    digits, hexes = "0123456789", "0123456789ABCDEFabcdef"
    starts = "".join(sorted({t[0] for t in _GENDER}))
    rests = "|".join(re.escape(t[1:]) for t in sorted(_GENDER, key=len, reverse=True))
    tests = [
        rf"[{digits}].?.?[{digits}]",
        rf":[{hexes}:]",
        r"[Agsx](?:KIA|Iza|h[opsu]_|k[-_]|ox)",
        r"[=:>](?:[ \t]*[\"']?[A-Za-z0-9+/_-]{16}|:[Ff])",
        rf"[{starts}](?:{rests})\.? ",
    ]
    found = F.contains(text, F.lit("@"))
    for test in tests:
        found = found | text.rlike(test)
    return found


def _script(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        for script, (first, last) in LETTERS.items():
            if first <= c.casefold() <= last:
                return script
    return "latin"


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and canonical value of each entity, in order, apart from each other.

    Equal entities have equal values however they are written: addresses in lower case, numbers by their digits,
    with a plus where a country code is written. A name gives one entity per part, so that it is the same person with and without the given name. Names are
    found after a title, and from then on and before wherever their parts (of two letters or more) stand
    capitalised in the same text. A name without a title in its text is not found.
    """
    found = list(_announced(text))
    names = {}
    for start, end, kind, value in found:
        if kind.startswith(("given", "family")) and end - start > 1:
            names.setdefault(value, (kind, text[start:end]))
    if not names:
        yield from found
        return
    taken = iter(found)
    ahead = next(taken, None)
    for start, end in _known(text, names):
        while ahead and ahead[1] <= start:
            yield ahead
            ahead = next(taken, None)
        if ahead is None or end <= ahead[0]:
            value = text[start:end].casefold()
            yield start, end, names[value][0], value
    if ahead:
        yield ahead
    yield from taken


def _known(text: str, names: dict) -> Iterator[tuple[int, int]]:
    """Where known names stand capitalised; of a word joined by hyphens or apostrophes the longest known piece counts."""
    for m in _WORD.finditer(text):
        cuts = [m.start(), *(m.start() + k for k, c in enumerate(m.group()) if c in "-'"), m.end()]
        first = 0
        while first < len(cuts) - 1:
            start = cuts[first] + (first > 0)
            for last in range(min(len(cuts) - 1, first + 4), first, -1):
                if text[start : cuts[last]].casefold() in names and not text[start].islower():
                    yield start, cuts[last]
                    first = last - 1
                    break
            first += 1


def _announced(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The entities that their own form or a title shows."""
    low = text.lower()
    wide = "::" in text or any(key in low for key in _KEYS)
    for m in (_WIDE if wide else _PATTERN).finditer(text):
        kind = m.lastgroup
        if kind in ("name", "title"):
            at, parts = m.start("name"), m.group("name").split(" ")
            gender = _GENDER[m.group("title")]
            for i, part in enumerate(parts):
                last = i == len(parts) - 1
                script = _script(part)
                yield at, at + len(part), f"family:{script}" if last else f"given:{script}:{gender}", part.casefold()
                at += len(part) + 1
            continue
        if kind in ("assigned", "value"):
            yield m.start("value"), m.end("value"), "secret", m.group("value")
            continue
        value = m.group()
        if kind in ("card", "ssn", "phone"):
            digits = re.sub(r"\D", "", value)
            if kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            yield m.start(), m.end(), kind, "+" + digits if value.startswith("+") else digits
        elif kind == "iban":
            yield m.start(), m.end(), kind, value.replace(" ", "")
        elif kind == "ipv6":
            try:
                yield m.start(), m.end(), kind, IPv6Address(value).compressed
            except ValueError:  # too many groups
                continue
        else:
            yield m.start(), m.end(), kind, value.lower() if kind == "email" else value


class _Draw:
    """Numbers that depend on the secret, the entity and the attempt alone."""

    def __init__(self, secret: str, *parts: str):
        self.seed, self.count, self.pool = "\0".join(parts).encode(), 0, 0
        self.key, self.left = blake2b(secret.encode()).digest()[:64], 0

    def below(self, n: int) -> int:
        if self.left < 8:
            self.pool = int.from_bytes(blake2b(self.seed + b"\0%d" % self.count, key=self.key).digest(), "big")
            self.count, self.left = self.count + 1, 64
        value, self.pool, self.left = self.pool & (2**64 - 1), self.pool >> 64, self.left - 8
        return value % n


def _like(text: str, draw: _Draw, letters: int = 26) -> str:
    """Letters to letters of the same case (to the first ``letters``), digits to digits, the rest as it is."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            out.append(chr(ord("a" if c.islower() else "A") + draw.below(letters)))
        else:
            out.append(c)
    return "".join(out)


def _exchanged(label: str, secret: str) -> str:
    """Another label of the same shape; different labels never get the same one, and none keeps its own.

    Labels of a shape are numbered, a keyed permutation shuffles the numbers, and each takes the next in that order.
    """
    radix = [10 if c.isdigit() else 26 if "a" <= c <= "z" else 1 for c in label]
    total = math.prod(radix)
    if total < 2:
        return label
    number = 0
    for c, r in zip(label, radix, strict=True):
        number = number * r + (0 if r == 1 else ord(c) - ord("0" if r == 10 else "a"))
    key = blake2b("\0".join([secret, "label", "".join("0" if r == 10 else "a" if r == 26 else c for c, r in zip(label, radix, strict=True))]).encode()).digest()
    side = math.isqrt(total - 1) + 1

    def mixed(half: int, step: int) -> int:
        size = (side.bit_length() + 7) // 8
        data = b"".join(blake2b(b"%d %d %d" % (half, step, k), key=key).digest() for k in range(size // 64 + 2))
        return int.from_bytes(data[: size + 16], "big")

    def steps(value: int, order: range, sign: int) -> int:
        while True:
            a, b = divmod(value, side)
            for step in order:
                if step % 2:
                    a = (a + sign * mixed(b, step)) % side
                else:
                    b = (b + sign * mixed(a, step)) % side
            value = a * side + b
            if value < total:
                return value

    number = steps((steps(number, range(5, -1, -1), -1) + 1) % total, range(6), 1)
    out = []
    for c, r in zip(reversed(label), reversed(radix), strict=True):
        number, digit = divmod(number, r)
        out.append(c if r == 1 else chr(ord("0" if r == 10 else "a") + digit))
    return "".join(reversed(out))


#: Country calling codes of one and two digits; all others have three. None begins another.
_COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")


def country(phone: str) -> str:
    """The plus and the country code of a canonical number; empty where it was written without."""
    return m.group() if (m := _COUNTRY.match(phone)) else ""


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def surrogate(secret: str, kind: str, value: str, attempt: int) -> str:
    """The canonical surrogate of an entity; later attempts give other ones, longer ones where the first were few."""
    draw = _Draw(secret, kind, value, str(attempt))
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        *labels, top = domain.split(".")
        host = lambda label: _exchanged(label, secret)
        more = "" if attempt < 3 else _like("a" * (attempt - 2), draw)  # widens the pool
        return f"{_like(local, draw)}{more}@{'.'.join(host(label) for label in labels)}.{top}"
    if kind == "ipv4":
        private = re.match(r"10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|127\.", value)
        kept = private.group().split(".")[:-1] if private else []
        kept = ["10"] if private and attempt > 2 and kept[0] != "127" else kept  # the largest private range
        return ".".join([*kept, *(str(1 + draw.below(254)) for _ in range(4 - len(kept)))])
    if kind == "ipv6":
        groups = [int(g, 16) for g in IPv6Address(value).exploded.split(":")]
        zeros = [i for i in range(7, 0, -1) if not groups[i]][:max(0, attempt - 2)]
        for i in range(8):
            if i == 0 and 0x2000 <= groups[0] < 0x4000:
                groups[0] = 0x2000 + draw.below(0x2000)
            elif (groups[i] and (i or groups[0] < 0xFC00)) or i in zeros:
                groups[i] = 1 + draw.below(65535)
        return IPv6Address(":".join(f"{g:x}" for g in groups)).compressed
    if kind == "card":
        body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        valid = [d for d in "0123456789" if luhn(body + d) == luhn(value)]
        return body + valid[draw.below(len(valid))]
    if kind == "iban":
        body = _like(value[4:], draw)
        if not iban_ok(value):
            return value[:2] + _like(value[2:4], draw) + body
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{98 - rest:02d}{body}"
    if kind in ("ssn", "phone"):
        kept = country(value)
        return kept + "".join(str(1 + draw.below(9)) if i == 0 and c != "0" else str(draw.below(10)) for i, c in enumerate(value[len(kept):]))
    if kind == "secret":
        prefix = re.match(r"(?:AKIA|gh[opsu]_|sk[-_](?:live[-_]|test[-_])?|xox[abp]-|AIza)?", value).group()
        body = value[len(prefix):]
        more = "" if attempt < 3 else _like("a" * (attempt - 2), draw, 6)
        return prefix + more + _like(body, draw, 6 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body) else 26)
    part, script, *gender = kind.split(":")
    if script in LETTERS:
        first, last = map(ord, LETTERS[script])
        return "".join(chr(first + draw.below(last - first + 1)) for _ in range(len(value) + attempt // 3)).casefold()
    if part == "given":
        pool = GIVEN[script, gender[0]] if gender[0] in "mf" else GIVEN[script, "m"] + GIVEN[script, "f"]
    else:
        pool = FAMILY[script]
    ends = ENDINGS[script]
    name = pool[draw.below(len(pool))]
    return (name + "".join(ends[draw.below(len(ends))] for _ in range(attempt))).casefold()


def pool(kind: str, value: str) -> tuple[str, float]:
    """What an entity's surrogates can be drawn from in the end, by name, and how many there are.

    Infinite for kinds whose later attempts give longer ones or whose shortest form has some 10^11.
    """
    if kind == "ipv4":
        if re.match(r"10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|127\.", value):
            return "loopback" if value.startswith("127.") else "private", 254.0**3
        return "public", 254.0**4
    if kind in ("ssn", "phone"):
        kept = country(value)
        return f"{kept} {len(value)}", 9 * 10.0 ** (len(value) - len(kept) - 1)
    return "", float("inf")


def rendered(kind: str, written_as: str, drawn: str) -> str:
    """A canonical surrogate in the way its entity was written: separators, spacing and case."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(drawn.lstrip("+"))
        return "".join(next(rest) if c.isalnum() else c for c in written_as)
    if kind == "ipv6":
        groups = IPv6Address(drawn).exploded.split(":")
        if "::" not in written_as:
            padded = all(len(g) == 4 for g in written_as.split(":"))
            drawn = ":".join(g if padded else g.lstrip("0") or "0" for g in groups)
        return drawn.upper() if written_as != written_as.lower() else drawn
    if kind.startswith(("given", "family")):
        return drawn.upper() if written_as.isupper() and len(written_as) > 1 else drawn[:1].upper() + drawn[1:]
    return drawn.upper() if kind == "email" and written_as.isupper() else drawn


def found_entities(docs: DataFrame) -> DataFrame:
    """node (md5 of the text), kind, value: the distinct entities of every distinct text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("node")
            rows = [(node, kind, value) for node, text in zip(batch["node"], batch["_text"]) for *_, kind, value in entities(text)]
            if rows:
                yield pd.DataFrame(rows, columns=["node", "kind", "value"]).drop_duplicates()

    texts = docs.select(plain_text().alias("_text")).filter(may_hold(F.col("_text"))).select(F.unhex(F.md5("_text")).alias("node"), "_text")
    return texts.mapInPandas(run, "node binary, kind string, value string").distinct()


def resolved(rows: DataFrame) -> DataFrame:
    """``rows`` with ``person``, the kind to draw from: a given name whose title tells no gender has that of its namesakes.

    Namesakes of the same text come first, then those of all texts, each if they agree.
    """
    given = rows.filter(F.col("kind").startswith("given:"))
    parts = F.split("kind", ":")
    known = given.select("node", "value", parts[1].alias("script"), parts[2].alias("gender"))
    told = known.filter("gender != 'u'")
    agreed = F.when(F.min("gender") == F.max("gender"), F.min("gender"))
    here = told.groupBy("node", "script", "value").agg(agreed.alias("here"))
    anywhere = told.groupBy("script", "value").agg(agreed.alias("anywhere"))
    open_ = known.filter("gender = 'u'").join(here, ["node", "script", "value"], "left").join(anywhere, ["script", "value"], "left")
    person = F.concat_ws(":", F.lit("given"), "script", F.coalesce("here", "anywhere", F.lit("u")))
    found = open_.select("node", F.concat_ws(":", F.lit("given"), "script", F.lit("u")).alias("kind"), "value", person.alias("person"))
    rest = rows.filter(~(F.col("kind").startswith("given:") & F.col("kind").endswith(":u")))
    return rest.withColumn("person", F.col("kind")).unionByName(found)


def _of_kin(kind: Column) -> Column:
    """What must be told apart: all names among each other, other kinds each by itself."""
    return F.when(kind.startswith("given:") | kind.startswith("family:"), F.lit("name")).otherwise(kind)


def chosen_surrogates(known: DataFrame, secret: str) -> DataFrame:
    """kind, value, surrogate for distinct entities: no two of a kind (names: of all kinds) share one, and none is a real one.

    All are drawn at once; of those that collide the least keeps its draw and the others draw again. Where the real
    entities fill more than a quarter of what they can be drawn from, such draws would take long or never end: there
    each takes the value of another entity of its pool, in circles by keyed hash, so that surrogates still differ
    from each other and from what they stand for.
    """

    @F.pandas_udf("string")
    def draw(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(secret, k, v, int(a)) for k, v, a in zip(kind, value, attempt)], dtype=object)

    @F.pandas_udf("struct<pool:string,size:double,hash:bigint>")
    def pooled(kind: pd.Series, value: pd.Series) -> pd.DataFrame:
        rows = [(*pool(k, v), _Draw(secret, "circle", k, v).below(2**63)) for k, v in zip(kind, value)]
        return pd.DataFrame(rows, columns=["pool", "size", "hash"])

    real = written(known.select("kind", "value").distinct(), "pii-entities")
    taken = real.select(_of_kin(F.col("kind")).alias("kin"), F.col("value").alias("surrogate")).distinct()
    few = real.filter(F.col("kind").isin("ipv4", "ssn", "phone")).select("kind", "value", pooled("kind", "value").alias("p")).select("kind", "value", "p.*")
    full = few.groupBy("kind", "pool", "size").agg(F.count("*").alias("n")).filter("4 * n > size").select("kind", "pool", "n")
    full = written(full, "pii-full")
    if full.isEmpty():
        circled = None
    else:
        part = F.pmod("hash", F.ceil(F.col("n") / CIRCLE))
        held = few.join(F.broadcast(full), ["kind", "pool"]).withColumn("part", part)
        own = W.partitionBy("kind", "pool", "part").orderBy("hash", "value")
        first = F.first("value").over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        circled = written(held.select("kind", "value", F.coalesce(F.lead("value").over(own), first).alias("surrogate")), "pii-circled")
        real = real.join(circled, ["kind", "value"], "left_anti")
    first_draw = real.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw("kind", "value", "attempt"))
    drawn = written(first_draw.withColumn("kin", _of_kin(F.col("kind"))), "pii-surrogates")
    while True:
        who = F.struct("value", "kind")
        shared = drawn.groupBy("kin", "surrogate").agg(F.count("*").alias("n"), F.min(who).alias("keeps")).filter("n > 1")
        losers = drawn.join(shared, ["kin", "surrogate"]).filter(who != F.col("keeps")).select("kind", "value")
        again = losers.union(drawn.join(taken, ["kin", "surrogate"], "left_semi").select("kind", "value")).distinct()
        again = written(again.withColumn("again", F.lit(1)), "pii-again")
        if again.isEmpty():
            drawn = drawn.select("kind", "value", "surrogate")
            return drawn.unionByName(circled) if circled else drawn
        marked = drawn.join(again, ["kind", "value"], "left")
        attempt = F.col("attempt") + F.coalesce("again", F.lit(0))
        moved = marked.select("kind", "value", attempt.alias("attempt"), "again", "surrogate", "kin")
        fresh = moved.filter("again = 1").withColumn("surrogate", draw("kind", "value", "attempt"))
        drawn = written(moved.filter("again is null").unionByName(fresh).drop("again"), "pii-surrogates")


def replaced(docs: DataFrame, secret: str = "surrogates") -> DataFrame:
    """The documents with surrogates in their text, ``n_entities`` and ``entity_kinds`` added.

    The same entity has the same surrogate in all documents, different entities have different ones. Null texts
    stay null; texts without an entity stay as they are; columns of those two names are replaced. A text is searched
    once to find its entities; from then on it is known by its md5. Only the entities travel, and to the texts that
    hold them: while their table is small by rows and bytes it is sent, beyond that texts are shuffled by their md5.
    An empty table gives none; a text of any length is searched in time linear in it.
    """
    rows = written(resolved(written(found_entities(docs), "pii-found")), "pii-persons")
    chosen = chosen_surrogates(rows.select(F.col("person").alias("kind"), "value"), secret).withColumnRenamed("kind", "person")
    per_text = (
        rows.join(chosen, ["person", "value"])
        .groupBy("node")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\0", "kind", "value"), "surrogate"))).alias("__map"))
    )
    per_text = written(per_text.withColumnRenamed("node", "__key"), "pii-maps")
    kept = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]

    @F.pandas_udf("struct<text:string,n:bigint,kinds:string>")
    def apply(texts: pd.Series, maps: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [rewritten(t, dict(m)) if m else (None, 0, "") for t, m in zip(texts, maps, strict=True)], columns=["text", "n", "kinds"]
        )

    keyed = docs.select(*kept).withColumn("__node", F.unhex(F.md5(plain_text())))
    sent = F.broadcast(per_text) if is_small(per_text) else per_text
    joined = keyed.join(sent, F.col("__node") == F.col("__key"), "left")
    changed = joined.withColumn("__new", apply(F.when(F.col("__map").isNotNull(), plain_text()), F.col("__map")))
    new = F.coalesce("__new.text", "text").alias("text")
    return changed.select(
        *(new if c == "text" else F.col(c) for c in kept), F.col("__new.n").alias("n_entities"), F.col("__new.kinds").alias("entity_kinds")
    )


def rewritten(text: str, surrogates: dict[str, str]) -> tuple[str, int, str]:
    """The text with its entities replaced, their number, and their kinds."""
    out, at, kinds, n = [], 0, set(), 0
    for start, end, kind, value in entities(text):
        out += [text[at:start], rendered(kind, text[start:end], surrogates[f"{kind}\0{value}"])]
        at, n = end, n + 1
        kinds.add(kind.partition(":")[0])
    return "".join([*out, text[at:]]), n, ",".join(sorted(kinds))
