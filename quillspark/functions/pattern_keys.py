"""Which words a text must hold for a pattern to match, read off the pattern itself.

Substitutions are many and rarely match. A text's words are looked up once in the set of all such words; only
substitutions one of whose words was met are tried. All of it is conservative: what can't be read off is always tried.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

#: In the readings of a pattern: a place where a word begins or ends, and text that is not known; \x02 is a sign of some kind.
_EDGE, _ANY = "\x01", "\x00"
_MOST = 400
_COMMON = set("a an and are as at be but for from had he her his i if in is it its me my not of on or our s she so t that the their then there they this to was we were what who will with you".split())
_WORD = re.compile("[a-z0-9_]")
_NO_WORD = ",.;:!?\"“”'()[]*#—-\n \t\x02"


def _class(items: list) -> str:
    """A reading for one character out of a class."""
    if items and items[0][0] is C.NEGATE:
        return _ANY
    for op, at in items:
        chars = chr(at) if op is C.LITERAL else "a" if op is C.RANGE else " " if op is C.CATEGORY and at is C.CATEGORY_SPACE else "a"
        if op is C.RANGE and not any(_WORD.match(chr(x).lower()) for x in range(at[0], min(at[1], at[0] + 300) + 1)):
            chars = " "
        if _WORD.match(chars.lower()):
            return _ANY
    return "\x02" if len(items) > 1 or items[0][0] is not C.LITERAL else chr(items[0][1])


def _readings(parsed) -> list[str] | None:
    """All readings of a pattern, or None if these are too many."""
    out = [""]
    for op, at in parsed:
        if op is C.LITERAL:
            more = [chr(at).lower()]
        elif op is C.NOT_LITERAL or op is C.ANY or op is C.GROUPREF:
            more = [_ANY]
        elif op is C.IN:
            more = [_class(at)]
        elif op is C.AT:
            more = [_EDGE]
        elif op is C.BRANCH:
            parts = [_readings(p) for p in at[1]]
            if None in parts:
                return None
            more = [x for p in parts for x in p]
        elif op is C.SUBPATTERN:
            more = _readings(at[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            once = _readings(at[2])
            if once is None:
                return None
            plain = all(x and all(ch in _NO_WORD for ch in x) for x in once)
            more = (once if plain or at[1] == 1 else [_ANY]) + ([""] if at[0] == 0 else [])
        elif op is C.ASSERT:
            more = [""]
        else:
            return None
        if more is None or len(out) * len(more) > _MOST:
            return None
        out = list(dict.fromkeys(a + b for a in out for b in more))
    return out


def readings(regex: str) -> list[str] | None:
    """regex: as in pattern_edits, with {B} and {S}."""
    source = regex.format(B=r"\b", S=r"\s").replace(r"\z", r"\Z")
    return _readings(_parser.parse(source))


def needs(regex: str) -> frozenset[str] | None:
    """Words in lower case of which every match holds one as a whole word; None: no such words are known."""
    found = set()
    for reading in readings(regex) or [""]:
        whole = [m.group(1) for m in re.finditer(f"(?<![a-z0-9_{_ANY}])([a-z0-9_]+)(?![a-z0-9_{_ANY}])", f"{_ANY}{reading}{_ANY}")]
        if not whole:
            return None
        found.add(max(whole, key=lambda w: (w not in _COMMON, len(w))))
    return frozenset(found)


def _keeps_words(regex: str, replacement: str) -> bool:
    """Whether a substitution makes no words but those in its replacement: it begins and ends between words, and joins none."""
    all_ = readings(regex)
    if not all_:
        return False
    outer = lambda c: c != "" and c in _NO_WORD
    left, right = [r[:1] for r in all_], [r[-1:] for r in all_]
    if not all(c == _EDGE or outer(c) for c in left + right):
        return False
    if replacement == "":
        return all(c == _EDGE for c in left) or all(c == _EDGE for c in right)
    return (all(c == _EDGE for c in left) or outer(replacement[0])) and (all(c == _EDGE for c in right) or outer(replacement[-1]))


def mark(regex: str) -> str | None:
    """A sign that every match holds, other than white space and what stands in words; None: no such sign is known."""
    all_ = readings(regex)
    signs = [m for m in ",#*—;?!." if all_ and all(m in r for r in all_)]
    return signs[0] if signs else None


def guards(rules: list[tuple[str, str]]) -> list[frozenset[str] | None]:
    """For each substitution the words without which neither it nor an earlier one that could make its words finds anything."""
    out: list[frozenset[str] | None] = []
    for i, (regex, _) in enumerate(rules):
        own = needs(regex)
        for j in range(i - 1, -1, -1):
            if own is None:
                break
            made = set(re.findall("[a-z0-9_]+", re.sub(r"\$\d", " ", rules[j][1].lower())))
            if not _keeps_words(*rules[j]) or made & own:
                own = None if out[j] is None else own | out[j]
        out.append(own)
    return out


#: Letters of a word that are compared.
BEGIN = 4


def phrase_key(phrase: str) -> str | None:
    """The beginning of a word that a text in lower case holds wherever it holds the phrase; None: no such word is known.

    A phrase is found inside words too, so its first word may be the end of one and its last word the beginning of one.
    """
    words = [(m.start() > 0, m.end() < len(phrase), m[0]) for m in re.finditer(r"[a-z0-9_]+", phrase)] if phrase.isascii() else []
    known = [w for begun, ended, w in words if begun and (ended or len(w) >= BEGIN)]
    return max(known, key=lambda w: (w not in _COMMON, len(w)))[:BEGIN] if known else None


def boundaries(regex: str) -> str:
    """regex with {B} at either end as one look, where a letter, digit or _ stands beside it."""
    head = re.match(r"(?:\(\?[im]+\))?(?=\{B\})", regex)
    at = readings(regex) if head or regex.endswith("{B}") else None
    if at and head and all(r[:1] == _EDGE and _WORD.match(r[1:2]) for r in at):
        regex = regex[: head.end()] + r"(?<!\w)" + regex[head.end() + 3 :]
    if at and regex.endswith("{B}") and all(r[-1:] == _EDGE and _WORD.match(r[-2:-1]) for r in at):
        regex = regex[:-3] + r"(?!\w)"
    return regex
