"""Personal data: detected entities receive surrogates.

A surrogate is drawn from a keyed hash of the entity (never of its place), so one entity has one surrogate in the
whole corpus and in every way of writing it; it has the entity's type, format, script and gender. Entities of the
whole table are gathered once each and their surrogates checked: no two entities may share one, and none may be
another entity that occurs. Those that collide are drawn again, at the next attempt, until none does. Kinds whose
values are numbered (addresses, cards, ...) are permuted within their range, so that they are distinct at any attempt;
where a range is so full that no free values are left, the permutation alone stands: still distinct, never itself.

A person is found by a title (Mr, Frau, ...), by an introduction (my name is ...) or by a given name of the lists before
a family name; the words of a name that was found are then replaced wherever they stand in the document with a capital.
A name that no document introduces in one of these ways is out of reach. What is known of a given name's gender is
gathered over the whole table, so that one name has one surrogate.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import _flat
from lodestone.llm._common import col, forget, ship, stored, text_key

_NAMES = {
    ("latin", "m"): "Adrian Albert Andreas Anton Arthur Benedict Bruno Carl Cedric Clemens Conrad Daniel Dennis Edgar Edwin Emil Eric Felix Frederic George Gilbert Gregor Harald Henry Hugo Ivan Jacob Jasper Jonas Julian Karl Kevin Leon Leonard Louis Lucas Magnus Marcel Martin Maurice Nathan Nicolas Norbert Oliver Oscar Otto Patrick Paul Philip Ralph Raymond Robert Roland Samuel Simon Stefan Theodor Thomas Ulrich Victor Vincent Walter Werner Xavier",
    ("latin", "f"): "Adele Agnes Alice Amelia Andrea Anna Astrid Barbara Beatrice Berta Camilla Carla Caroline Charlotte Clara Cornelia Denise Diana Dora Edith Elena Elisa Emma Erica Eva Flora Frida Gisela Greta Hanna Helen Ida Ines Irene Isabel Jana Johanna Judith Julia Karin Laura Lena Linda Lucia Lydia Margaret Maria Marta Miriam Nadia Nora Olga Paula Petra Regina Rosa Ruth Sara Silvia Sofia Tanja Teresa Ursula Vera",
    ("latin", "n"): "Alex Andy Ariel Ashley Bailey Blake Cameron Casey Chris Dana Devon Drew Eden Elliot Emery Finley Francis Frankie Gale Harper Hayden Jamie Jean Jesse Jordan Jules Kai Kelly Kim Lee Logan Mika Morgan Noel Pat Quinn Reese Riley Robin Rowan Sage Sam Sasha Sidney Skyler Taylor Terry Toni Tracy Val",
    ("latin", ""): "Abbott Acker Albers Aldridge Baldwin Barlow Becker Bishop Blanchard Boyd Brandt Caldwell Carver Castillo Chandler Colbert Cortes Dalton Decker Delgado Dorsey Dubois Eckhart Ellison Falk Farrell Ferrer Fischer Fontaine Gallagher Garnier Gibson Goddard Graves Hagen Hale Harding Hartmann Hobbs Holloway Ingram Jansen Keller Kendall Kramer Lambert Lang Lawson Lindner Lombard Marsh Mercer Moreau Nash Navarro Norwood Osborne Paxton Peralta Pruitt Quimby Ramsey Reyes Rowland Salazar Sawyer Schreiber Sexton Sherwood Stanton Steiner Sutton Tanner Thorne Trujillo Underwood Vance Vargas Vogel Wagner Wallace Weaver Whitaker Winkler Yates Ziegler",
    ("cyrillic", "m"): "Алексей Андрей Антон Борис Вадим Виктор Владимир Геннадий Георгий Дмитрий Евгений Егор Иван Игорь Кирилл Константин Леонид Максим Михаил Никита Олег Павел Пётр Роман Сергей Степан Тимур Фёдор Юрий Ярослав",
    ("cyrillic", "f"): "Александра Алина Анастасия Анна Валентина Варвара Вера Виктория Галина Дарья Евгения Екатерина Елена Жанна Зоя Инна Ирина Ксения Лариса Людмила Марина Мария Надежда Наталья Оксана Ольга Полина Светлана Татьяна Юлия",
    ("cyrillic", ""): "Абрамов Белов Виноградов Волков Голубев Давыдов Егоров Жуков Зайцев Захаров Калинин Киселёв Козлов Крылов Лебедев Макаров Медведев Морозов Никитин Новиков Орлов Павлов Поляков Романов Савельев Соколов Тарасов Титов Фролов Шестаков",
    ("han", "m"): "建国 志强 伟明 海涛 文斌 俊杰 国栋 浩然 立新 鹏飞 少华 思远 天宇 永刚 振华 子轩",
    ("han", "f"): "春梅 丽娜 美玲 淑芬 雪莹 晓燕 雅婷 玉兰 月华 佳怡 静怡 诗涵 婉清 秀英 欣妍 梓萱",
    ("han", ""): "陈 程 邓 董 范 冯 高 郭 韩 何 胡 黄 贾 江 蒋 李 梁 林 刘 罗 吕 马 潘 彭 沈 宋 苏 孙 唐 田 王 魏 吴 谢 徐 许 薛 杨 叶 于 余 袁 曾 张 赵 郑 周 朱",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιάννης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σπύρος Στέφανος Χρήστος",
    ("greek", "f"): "Αγγελική Αικατερίνη Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ιωάννα Κωνσταντίνα Μαρία Σοφία Χριστίνα",
    ("greek", ""): "Αντωνίου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Μακρής Νικολάου Οικονόμου Παππάς Πετρίδης Σταύρου Χατζής",
}
_NAMES = {k: v.split() for k, v in _NAMES.items()}
_MALE, _FEMALE = {n.casefold() for k, v in _NAMES.items() if k[1] == "m" for n in v}, {n.casefold() for k, v in _NAMES.items() if k[1] == "f" for n in v}
_TITLES = {"mr": "m", "herr": "m", "herrn": "m", "señor": "m", "sr": "m", "don": "m", "monsieur": "m", "m": "m", "господин": "m", "г-н": "m", "κύριος": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "sra": "f", "srta": "f", "doña": "f", "madame": "f", "mme": "f", "mlle": "f", "госпожа": "f", "г-жа": "f", "κυρία": "f", "dr": "n", "prof": "n", "доктор": "n"}
_UPPER = r"[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ]"
_NAME = rf"{_UPPER}(?:\.|[\w'’]+(?:-{_UPPER}[\w'’]+)*)"
_WRITTEN = "Mr Mrs Ms Miss Herr Herrn Frau Señor Señora Sr Sra Srta Don Doña Monsieur Madame Mme Mlle Dr Prof Господин Госпожа Г-н Г-жа Κύριος Κυρία Доктор".split()
_ANY_TITLE = "|".join(sorted({x for w in _WRITTEN for x in (w, w.upper(), *([w.lower()] if w[0] == "Г" else []))}, key=lambda x: (-len(x), x)))
_PARTICLES = "de del della der den des di da do dos das du la las le los el van von vom zu zum zur ter ten y e bin ibn al".split()
_FULL = rf"{_NAME}(?:[  ](?:(?:{'|'.join(_PARTICLES)})[  ])*{_NAME})*"
_PERSON = rf"(?P<title>\b(?:{_ANY_TITLE})\b\.?)[  ](?P<name>{_FULL})"
_INTRO = r"(?i:my name is|mein name ist|je m['’]appelle|me llamo|mi nombre es|меня зовут)"
_WORD = re.compile(rf"(?<![\w'’\-]){_NAME}")
_HAN = r"(?P<hanname>[陈程邓董范冯高郭韩何胡黄贾江蒋李梁林刘罗吕马潘彭沈宋苏孙唐田王魏吴谢徐许薛杨叶于余袁曾张赵郑周朱][一-龥]{0,2})(?P<hantitle>先生|女士|小姐)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_FIND = re.compile(
    rf"(?P<email>(?<![\w.+\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+)|(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d))|(?P<iban>\b[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b)|(?P<ssn>(?<![\w\-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w\-]))|(?P<card>(?<![\w\-+.])(?:\d{{4}}(?:[ \-]?\d{{4}}){{2}}[ \-]?\d{{1,7}}|\d{{4}}[ \-]?\d{{6}}[ \-]?\d{{5}})(?![\w\-]))"
    rf"|(?P<phone>(?<![\w\-+.])(?:\+\d{{1,3}}[ .\-]?(?:\(\d{{1,5}}\)|\d{{1,5}})(?:[ .\-]?\d{{2,5}}){{1,4}}|\(\d{{3}}\) ?\d{{3}}[.\-]\d{{4}}|\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}})(?![\w]))|{_PERSON}|\b(?P<intro>{_INTRO})[  ](?P<introname>{_FULL})|{_HAN}"
)
#: What any text with an entity matches; the rest is passed on unseen. The engine of Arrow (RE2) scans for it once.
PREFILTER = rf"[@\p{{Nd}}]|先生|女士|小姐|{_INTRO}|(?:^|[^\pL\pN_])(?:{_ANY_TITLE}|{'|'.join(sorted(n for k, v in _NAMES.items() if k[0] != 'han' and k[1] in ('m', 'f') for n in v))})(?:[^\pL\pN_]|$)"


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _script(name: str) -> str:
    first = unicodedata.name(name[0], "LATIN").split()[0]
    return {"CYRILLIC": "cyrillic", "GREEK": "greek", "CJK": "han"}.get(first, "latin")


@dataclass(frozen=True)
class Mention:
    """A part of a text to be replaced: the entity, and how its surrogate is written in this place."""

    start: int
    end: int
    kind: str
    entity: str
    write: Callable[[str, str], str]


def _digits_into(text: str, surrogate: str) -> str:
    """The surrogate's characters in the places of the text's; digits of other scripts stay in their script."""
    it = iter(surrogate)
    out = []
    for c in text:
        new = next(it, c) if c.isalnum() else c
        out.append(chr(ord(c) - int(c) + int(new)) if not c.isascii() and c.isdecimal() and new.isdecimal() else new)
    return "".join(out)


def _cased(text: str, surrogate: str) -> str:
    if text.endswith(".") and len(text) == 2:
        return surrogate[0].upper() + "."
    return surrogate.upper() if text.isupper() and len(text) > 1 else surrogate.lower() if text.islower() else surrogate


def _sex(low: str, title: str) -> str:
    return "m" if low in _MALE else "f" if low in _FEMALE else title


def _parts(name: str) -> list[tuple[int, str, bool]]:
    """(place, word, whether it is a given name) of a written name: the last word is the family's, and with particles all
    that follow the first. Particles and initials say nothing and stay."""
    words = [(m.start(), m.group()) for m in re.finditer(r"[^  ]+", name)]
    family = next((k for k, (_, w) in enumerate(words) if w in _PARTICLES), len(words) - 1)
    out = [(at, w, k < family) for k, (at, w) in enumerate(words) if w not in _PARTICLES]
    return [(at, w, given) for at, w, given in out if not (given and len(w) == 2 and w.endswith("."))]


def _persons(text: str, found: list[tuple[int, str, str, bool]], taken: list[Mention]) -> list[Mention]:
    """Mentions of persons. ``found``: (place, name, sex of its title, whether a single word is a given name). Given and
    family names that the document introduces are replaced at each of their places."""
    given: dict[str, str] = {}
    family: set[str] = set()
    named: dict[int, str] = {}
    for at, name, title, first in found:
        parts = _parts(name)
        for where, word, is_given in parts:
            named[at + where] = word
            low = word.casefold()
            if is_given or first and len(parts) == 1:
                sex = _sex(low, title)
                if given.get(low, "n") == "n":
                    given[low] = sex
            elif len(parts) > 1:
                family.add(low)
    words = [(m.start(), m.group()) for m in _WORD.finditer(text)]
    for (at, word), (then, other) in zip(words, words[1:], strict=False):
        low = word.casefold()
        if then == at + len(word) + 1 and text[then - 1] in "  " and (low in _MALE or low in _FEMALE) and low not in family and len(other) > 2 and other not in _WRITTEN:
            given.setdefault(low, _sex(low, "n"))
            if other.casefold() not in given and other.casefold() not in _MALE | _FEMALE:
                family.add(other.casefold())
                named[then] = other
            named[at] = word
    for at, name, _, first in found:
        parts = _parts(name)
        if len(parts) == 1 and not first and parts[0][1].casefold() not in given:
            family.add(parts[0][1].casefold())
    covered = sorted((m.start, m.end) for m in taken)
    starts = [a for a, _ in covered]
    out = []
    if given or family:
        for at, word in sorted({**dict(words), **named}.items()):
            k = bisect_right(starts, at) - 1
            if k >= 0 and covered[k][1] > at:
                continue
            low = word.casefold()
            if low in family:
                out.append(Mention(at, at + len(word), f"family:{_script(word)}", low, _cased))
            elif low in given:
                out.append(Mention(at, at + len(word), f"given:{given[low]}:{_script(word)}", low, _cased))
    return out


def mentions(text: str) -> list[Mention]:
    """Ascending, without overlap. Entities are written in one way: lower case, digits without separators."""
    out: list[Mention] = []
    found: list[tuple[int, str, str, bool]] = []
    for m in _FIND.finditer(text):
        kind = m.lastgroup
        s, at = m.group(), m.start()
        if m.group("email"):
            local, _, domain = s.rpartition("@")
            low = domain.lower()
            out.append(Mention(at, at + len(local), "mailbox", f"{local.lower()}@{low}", _cased_mail))
            out.append(Mention(at + len(local) + 1, m.end(), "domain", low, _cased_mail))
        elif m.group("ip"):
            if not s.startswith(("0.", "127.")) and s != "255.255.255.255":
                out.append(Mention(at, m.end(), "ip", ".".join(str(int(x)) for x in s.split(".")), lambda _, x: x))
        elif m.group("name"):
            found.append((m.start("name"), m.group("name"), _TITLES.get(m.group("title").lower().rstrip("."), "n"), False))
        elif m.group("introname"):
            found.append((m.start("introname"), m.group("introname"), "n", True))
        elif m.group("hanname"):
            sex = "m" if m.group("hantitle") == "先生" else "f"
            name = m.group("hanname")
            out.append(Mention(at, at + 1, "family:han", name[0], _cased))
            if len(name) > 1:
                out.append(Mention(at + 1, at + len(name), f"given:{sex}:han", name[1:], _cased))
        else:
            plain = "".join(str(int(c)) if c.isdecimal() else c for c in s if c.isalnum())
            if kind == "card" and not (13 <= len(plain) <= 19 and plain[0] in "23456") or kind == "iban" and not _iban_ok(plain) or kind == "phone" and not 7 <= len(plain) <= 15:
                continue
            out.append(Mention(at, m.end(), kind, plain, _digits_into))
    return sorted(out + _persons(text, found, out), key=lambda m: m.start)


def _cased_mail(text: str, surrogate: str) -> str:
    return surrogate.upper() if text.isupper() else surrogate


class _Stream:
    """Numbers from a keyed hash of what they are for."""

    def __init__(self, key: bytes, *what: str) -> None:
        self.key, self.what, self.k, self.pool = key[:64], "\0".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool = hashlib.blake2b(self.what + self.k.to_bytes(4, "big"), key=self.key).digest()
            self.k += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n


_LATIN = "abcdefghijklmnopqrstuvwxyz"


@cache
def _relatives(c: str) -> str:
    """Characters of the class of ``c`` near it in Unicode, so of its script as a rule."""
    low = ord(c) & ~63
    return "".join(x for x in map(chr, range(low, low + 64)) if unicodedata.category(x) == unicodedata.category(c) and x.lower() == x) or c


def _like(c: str, s: _Stream) -> str:
    """Another character of the class and script of ``c``."""
    if "0" <= c <= "9":
        return str(s.below(10))
    if "a" <= c <= "z":
        return _LATIN[s.below(26)]
    if "A" <= c <= "Z":
        return _LATIN[s.below(26)].upper()
    if "а" <= c <= "я":
        return chr(ord("а") + s.below(32))
    if "α" <= c <= "ω":
        return chr(ord("α") + s.below(25)).replace("ς", "σ")
    if c.isalnum():
        near = _relatives(c)
        return near[s.below(len(near))]
    return c


def _feistel(x: int, half: int, key: bytes, what: bytes, rounds: range) -> int:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for r in rounds:
        f = int.from_bytes(hashlib.blake2b(what + bytes([r]) + right.to_bytes(32, "big"), key=key[:64]).digest(), "big") & mask
        left, right = right, left ^ f
    return right << half | left  # swapped, so that the rounds backwards undo it


def permuted(x: int, n: int, key: bytes, what: str) -> int:
    """A keyed permutation of range(n) with a single cycle: no value is its own."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    tag = what.encode()
    y = x
    while (y := _feistel(y, half, key, tag, range(6))) >= n:
        pass
    y = (y + 1) % n
    while (y := _feistel(y, half, key, tag, range(5, -1, -1))) >= n:
        pass
    return y


def _until(x: int, n: int, same: Callable[[int], bool], key: bytes, what: str) -> int:
    """Permuted within the part of range(n) that ``same`` holds for; x is in it."""
    while not same(x := permuted(x, n, key, what)):
        pass
    return x


def _ip_range(entity: str) -> tuple[str, int, int]:
    """(name, first address, size) of the range of an address that is kept."""
    a = [int(x) for x in entity.split(".")]
    if a[:2] == [192, 168]:
        return "192.168", 192 << 24 | 168 << 16, 1 << 16
    if a[0] == 10:
        return "10", 10 << 24, 1 << 24
    if a[0] == 172 and 16 <= a[1] <= 31:
        return "172.16", 172 << 24 | 16 << 16, 1 << 20
    return "public", 0, 1 << 32


def _public(x: int) -> bool:
    first, last = x >> 24, x & 255
    return 1 <= first <= 223 and first not in (10, 127, 169, 172, 192) and 1 <= last <= 254


#: Kinds whose values are numbered and permuted within their range.
BOUNDED = ("ip", "ssn", "card", "iban", "phone")


def space(kind: str, entity: str) -> str:
    """What surrogates must be distinct in: the kind without a guess of gender, the range of a number."""
    if kind == "ip":
        return f"ip {_ip_range(entity)[0]}"
    if kind in ("card", "phone"):
        return f"{kind} {len(entity)} {entity[0]}"
    if kind == "iban":
        return f"iban {entity[:2]} {len(entity)}"
    role, *rest = kind.split(":")
    return f"{role}:{rest[-1]}" if rest else kind


def _number(kind: str, entity: str, attempt: int, key: bytes) -> str:
    what = f"{kind} {attempt} "
    if kind == "ip":
        name, low, n = _ip_range(entity)
        x = int.from_bytes(bytes(int(p) for p in entity.split(".")), "big") - low
        plain = name == "public" and _public(x)
        y = low + (_until(x, n, _public, key, what + name) if plain else _until(x, n, lambda v: not _public(v) and _ip_range(".".join(map(str, v.to_bytes(4, "big"))))[0] == "public", key, what + name) if name == "public" else permuted(x, n, key, what + name))
        return ".".join(map(str, y.to_bytes(4, "big")))
    if kind == "ssn":
        valid = lambda v: 1 <= v // 10**6 <= 899 and v // 10**6 != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0
        x = int(entity)
        return f"{_until(x, 10**9, lambda v: valid(v) == valid(x), key, what):09d}"
    if kind == "card":
        m = len(entity) - 2  # the first digit stays; the last is the check, or as far from it as it was
        off = (int(entity[-1]) - luhn(entity[:-1])) % 10
        x = int(entity[1:-1]) if not off else int(entity[1:-1]) * 9 + off - 1
        y = permuted(x, 10**m * (9 if off else 1), key, f"{what}{entity[0]} {len(entity)} {bool(off)}")
        body, off = (f"{entity[0]}{y:0{m}d}", 0) if not off else (f"{entity[0]}{y // 9:0{m}d}", y % 9 + 1)
        return f"{body}{(luhn(body) + off) % 10}"
    if kind == "iban":
        radix = [10 if c.isdigit() else 26 for c in entity[4:]]
        x, n = 0, 1
        for c, r in zip(entity[4:], radix, strict=True):
            x, n = x * r + (int(c) if r == 10 else ord(c) - 65), n * r
        y = permuted(x, n, key, f"{what}{entity[:2]} {radix}")
        body = ""
        for r in reversed(radix):
            y, d = divmod(y, r)
            body = (str(d) if r == 10 else chr(65 + d)) + body
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - number % 97:02d}{body}"
    lead = max(1, len(entity) - 10) if len(entity) > 10 else 0  # the country's code stays
    m = len(entity) - lead
    x = int(entity[lead:])
    low = 2 * 10 ** (m - 1)
    return f"{entity[:lead]}{_until(x, 10**m, lambda v: (v >= low) == (x >= low), key, f'{what}{entity[:lead]} {len(entity)}'):0{m}d}"


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """Of the entity's type and form. Later attempts draw again; from the fourth on mailboxes, domains and names may be
    longer, so that their supply never ends. Numbers are permuted: at one attempt they are distinct."""
    s = _Stream(key, kind, entity, str(attempt))
    extra = max(0, attempt - 3)
    if kind == "mailbox":
        return "".join(_like(c, s) for c in entity.rpartition("@")[0]) + "".join(_LATIN[s.below(26)] for _ in range(extra))
    if kind == "domain":
        *labels, last = entity.split(".")
        labels = ["".join(_like(c, s) for c in x) for x in labels]
        labels[-1] += "".join(_LATIN[s.below(26)] for _ in range(extra))
        return ".".join([*labels, last])
    if kind in BOUNDED:
        return _number(kind, entity, attempt, key)
    role, *rest = kind.split(":")
    sex, script = (rest[0], rest[1]) if role == "given" else ("", rest[0])
    pool = _NAMES.get((script, sex)) or _NAMES.get((script, "m")) or _NAMES[("latin", "")]
    if script == "han":
        # characters of the names that the script's pool holds, as many as the name has
        letters = sorted(set("".join(pool)))
        return "".join(letters[s.below(len(letters))] for _ in range(len(entity) + extra))
    parts = [pool[s.below(len(pool))] for _ in entity.split("-")]
    if attempt:  # the pool may be too small: a name that is made of two
        tails = _NAMES[(script, "")]
        parts[-1] += "-" * (role == "family") + (tails[s.below(len(tails))] if role == "family" else pool[s.below(len(pool))].lower())
        parts[-1] += "".join(_like("а" if script == "cyrillic" else "α" if script == "greek" else "a", s) for _ in range(extra))
    name = "-".join(parts)
    if script == "cyrillic" and role == "family" and entity.endswith(("ова", "ева", "ёва", "ина", "ая")):
        name += "а" if name.endswith(("в", "н")) else ""
    return name


def _written(kind: str, entity: str, drawn: str) -> str:
    """A surrogate as an entity would be written, to compare it with those that occur."""
    return f"{drawn}@{entity.rpartition('@')[2]}" if kind == "mailbox" else drawn if kind == "ip" else drawn.casefold() if ":" in kind else drawn


def _maybe(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(texts, PREFILTER), False)


def _sift(wanted: bool):
    """Rows whose text can hold an entity, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = _maybe(batch.column("text"))
            yield batch.filter(some if wanted else pc.invert(some))

    return run


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in _flat.slices(whole.filter(_maybe(whole.column("text"))), "text"):
            rows: dict[tuple, None] = {}
            for k1, k2, text in zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), part.column("text").to_pylist(), strict=True):
                for m in mentions(text):
                    rows[k1, k2, m.kind, m.entity] = None
            names, kinds = ["k1", "k2", "kind", "entity"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names)


def _draw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, entities, attempts = (b.column(c).to_pylist() for c in ("kind", "entity", "attempt"))
            drawn = [surrogate(k, e, a, key) for k, e, a in zip(kinds, entities, attempts, strict=True)]
            written = [_written(k, e, d) for k, e, d in zip(kinds, entities, drawn, strict=True)]
            spaces = [space(k, e) for k, e in zip(kinds, entities, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), b.column("attempt"), *(pa.array(x, pa.string()) for x in (drawn, written, spaces))], ["kind", "entity", "attempt", "surrogate", "written", "space"])

    return run


_DRAWN = "kind string, entity string, attempt int, surrogate string, written string, space string"
#: Attempts after which the permutation alone stands in a range that is too full for values that occur nowhere.
MOST_ATTEMPTS = 24


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, surrogate, written, space) for distinct (kind, entity), without collisions: within a space no
    two entities have the same surrogate and no surrogate is itself an entity. In the ranges of numbers that are so full
    that some entity has found no free value in ``MOST_ATTEMPTS`` attempts, surrogates are other entities' values; they
    are distinct, and none is the entity's own."""
    drawn = stored(entities.distinct().withColumn("attempt", F.lit(0)).mapInArrow(_draw(key), _DRAWN), "surrogates")
    known = stored(drawn.select("space", "entity").distinct(), "entities")
    turn = 0
    while True:
        turn += 1
        order = Window.partitionBy("space", "written").orderBy("attempt", "entity", "kind")
        doubled = drawn.withColumn("nth", F.row_number().over(order)).where("nth > 1").select("kind", "entity", "space")
        taken = drawn.join(known.withColumnRenamed("entity", "written"), ["space", "written"], "left_semi").select("kind", "entity", "space")
        bad = stored(doubled.unionByName(taken).distinct(), "collisions")
        if bad.isEmpty():
            forget(bad, known)
            return drawn
        bounded = F.split("space", " ")[0].isin(*BOUNDED)
        if turn > MOST_ATTEMPTS:
            full = F.broadcast(bad.where(bounded).select("space").distinct())  # a range each, some hundreds at most
            again = drawn.join(full, "space", "left_semi").select("kind", "entity", F.lit(0).alias("attempt"))
            rest = bad.where(~bounded)
            open_ = drawn.join(full, "space", "left_anti")
            known_before, known = known, stored(known.join(full, "space", "left_anti"), "entities")
            forget(known_before)
            again = again.unionByName(open_.join(rest, ["kind", "entity"], "left_semi").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")))
            kept = open_.join(rest, ["kind", "entity"], "left_anti")
        else:
            again = drawn.join(bad, ["kind", "entity"], "left_semi").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
            kept = drawn.join(bad, ["kind", "entity"], "left_anti")
        before, drawn = drawn, stored(kept.unionByName(again.mapInArrow(_draw(key), _DRAWN)), "surrogates")
        forget(before, bad)


def resolved(found: DataFrame) -> DataFrame:
    """(kind, entity, whole): the kind that each (kind, entity) has in the whole table. What titles say of the gender of a
    given name is counted over all documents; where they disagree evenly it stays open."""
    counts = found.groupBy("kind", "entity").count()
    sex, bare = F.regexp_extract("kind", "^given:([mfn]):", 1), F.regexp_replace("kind", "^given:[mfn]:", "given:")
    votes = counts.withColumn("bare", bare).groupBy("bare", "entity").agg(F.sum(F.when(sex == "m", F.col("count")).when(sex == "f", -F.col("count")).otherwise(0)).alias("vote"))
    better = F.when(F.col("vote") > 0, "m").when(F.col("vote") < 0, "f").otherwise("n")
    whole = F.when(F.col("bare").startswith("given:"), F.concat(F.lit("given:"), better, F.lit(":"), F.substring_index("bare", ":", -1))).otherwise(F.col("bare"))
    return counts.withColumn("bare", bare).join(votes, ["bare", "entity"]).select("kind", "entity", whole.alias("whole"))


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in _flat.slices(whole, "text"):
            texts, counts = [], []
            for text, known in zip(part.column("text").to_pylist(), part.column("known").to_pylist(), strict=True):
                table = {(x["kind"], x["entity"]): x["surrogate"] for x in known or ()}
                out, at, n = [], 0, 0
                for m in mentions(text) if table else ():
                    out += [text[at : m.start], m.write(text[m.start : m.end], table[m.kind, m.entity])]
                    at, n = m.end, n + 1
                texts.append("".join([*out, text[at:]]))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_replaced"])


def replace_personal_data(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced) for every row; n_replaced counts the parts that were replaced (a mail address has two, its
    mailbox and its domain; a name one for each word).

    Null texts stay null and empty ones empty, with 0; a null id is passed on; repeated rows are replaced alike. A text of
    any length is read whole, in time linear in its length. An empty table gives no rows. Other columns are ignored,
    whatever their names. Ids are cast to long, what can't be is an error. Only texts that can hold an entity travel."""
    ship(docs.sparkSession)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    k1, k2 = text_key(F.col("text"))
    keyed = rows.withColumn("k1", k1).withColumn("k2", k2)
    found = stored(keyed.select("k1", "k2", "text").mapInArrow(_entities, "k1 long, k2 long, kind string, entity string"), "mentions").distinct()
    whole = stored(resolved(found), "kinds")
    table = assign(whole.select(F.col("whole").alias("kind"), "entity"), key).select(F.col("kind").alias("whole"), "entity", "surrogate")
    known = found.join(whole.join(table, ["whole", "entity"]).select("kind", "entity", "surrogate"), ["kind", "entity"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("known"))
    seen = rows.mapInArrow(_sift(True), "doc_id long, text string").withColumn("k1", k1).withColumn("k2", k2)
    changed = seen.join(known, ["k1", "k2"], "left").select("doc_id", "text", "known").mapInArrow(_replace, "doc_id long, text string, n_replaced long")
    return rows.mapInArrow(_sift(False), "doc_id long, text string").withColumn("n_replaced", F.lit(0).cast("long")).unionByName(changed)
