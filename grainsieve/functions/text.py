"""SQL expressions over text columns, as strings; all run inside the JVM.

Python's view of text is what the engine promises: white space and word characters are those of
Unicode. The classes are spelt out, so that other SQL engines read them alike.
"""

from __future__ import annotations

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OTHER_SPACE = SPACE.replace("-\\x{20}", "-\\x{1f}")
NOT_WORD = r"[^\p{L}\p{N}_]+"
_LETTER = r"a-z\p{L}\p{N}_"
OPEN, CLOSE, _END = "\u0001", "\u0002", "\u0004"


def quote(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(*phrases: str) -> str:
    """A regular expression for one of some phrases; a blank in a phrase is a single blank."""
    return "(?:" + "|".join(phrases) + ")"


def replace(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {quote(pattern)}, {quote(by)})"


def squeeze(c: str) -> str:
    """White space as single blanks, none at the ends; single blanks, which are most, are no matches, and other characters of ASCII are told by one comparison."""
    return f"trim({replace(c, f'(?![!-~])(?:{_OTHER_SPACE}{SPACE}*+| {SPACE}++)', ' ')})"


def plain(c: str) -> str:
    """HTML without tags; ends of blocks become full stops."""
    c = replace(c, r"(?i)</(?:div|h[1-6]|li|p|tr)>", ". ")
    c = replace(c, r"<[^>]+>", " ")
    c = replace(c, r":[\s]*\.", ":")
    c = replace(c, r"\.([\s]*\.)+", ".")
    return squeeze(c)


def cell(c: str) -> str:
    """HTML without tags."""
    return squeeze(replace(c, r"<[^>]+>", " "))


def pieces(c: str, pattern: str) -> str:
    """The non-empty parts between matches."""
    return f"filter(split({c}, {quote(pattern)}), x -> x <> '')"


def word_count(c: str) -> str:
    """Of white space left single, the blanks and one: no word becomes a value of its own."""
    return bound(squeeze(c), "_w", "IF(_w = '', 0, length(_w) - length(replace(_w, ' ', '')) + 1)")


def words(c: str, least: int) -> str:
    """Lower-case words of ``least`` or more letters a to z, in order.

    What stands before is part of the match: looking behind sees half of a letter beyond 16 bits.
    """
    return f"regexp_extract_all(lower({c}), {quote(f'(?:^|[^{_LETTER}])([a-z]{{{least},}}+)(?![{_LETTER}])')}, 1)"


def sentences(c: str, upper: bool) -> str:
    """Parts cut at white space after a sentence's end; with ``upper`` only before A to Z."""
    return f"split({c}, {quote('(?<=[.!?])' + SPACE + '+' + ('(?=[A-Z])' if upper else ''))})"


def array_of(items: list[str]) -> str:
    return "array(" + ", ".join(quote(i) for i in items) + ")"


def topics(c: str, stop: list[str]) -> str:
    return f"array_except(array_distinct({words(c, 4)}), {array_of(stop)})"


def jaccard(a: str, b: str) -> str:
    return f"IF(size({a}) = 0 OR size({b}) = 0, 0D, size(array_intersect({a}, {b})) / size(array_union({a}, {b})))"


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: What callers may look at around a match besides its sentence, in characters.
AROUND = 100
_ENDS = r"[.!?\n]"
NO_MATCHES = "cast(array() as array<struct<ord:int,match:string,before:string,after:string>>)"


def matches(c: str, pattern: str, *, whole: bool = False, first_of: str = "") -> str:
    """All matches in order: array of (ord from 1, match, before, after).

    ``before`` and ``after`` reach at least to the ends of the sentence and over ``AROUND`` characters, as far
    as the text does; with ``whole`` they are all of the text. So a match usually carries the text between it
    and its neighbours, and long texts with many matches stay linear. ``first_of`` is a condition on ``d``: only the first
    match of each text that meets it, and surroundings are made of no other.
    """
    parts = f"split(regexp_replace({c}, {quote(pattern)}, '{OPEN}$0{CLOSE}'), '{OPEN}')"
    joined = lambda start, n: f"translate(array_join(slice(p, {start}, {n}), ''), '{CLOSE}', '')"
    before = lambda k: joined(f"greatest(1, i - {k - 1})", f"least(i, {k})")
    rest = f"substr(p[i], locate('{CLOSE}', p[i]) + 1)"
    after = lambda k: f"concat({rest}, {joined('i + 2', k - 1)})"
    far = lambda x: f"({x} rlike {quote(_ENDS)} AND length({x}) >= {AROUND})"
    left, right = joined("1", "i"), f"concat({rest}, {joined('i + 2', 'size(p)')})"
    if not whole:
        left = bound(before(1), "u", f"IF(i <= 1 OR {far('u')}, u, {bound(before(8), 'v', f'IF(i <= 8 OR {far("v")}, v, {left})')})")
        right = bound(rest, "u", f"IF(i + 1 >= size(p) OR {far('u')}, u, {bound(after(8), 'v', f'IF(i + 8 >= size(p) OR {far("v")}, v, {right})')})")
    each = f"named_struct('ord', i, 'match', substring_index(p[i], '{CLOSE}', 1), 'before', {left}, 'after', {right})"
    places = "IF(size(p) > 1, sequence(1, size(p) - 1), cast(array() as array<int>))"
    if first_of:
        places = bound(f"transform({places}, i -> substring_index(p[i], '{CLOSE}', 1))", "k", f"transform(filter(array_distinct(k), d -> {first_of}), d -> CAST(array_position(k, d) AS int))")
    found = bound(parts, "p", f"transform({places}, i -> {each})")
    return f"IF({c} rlike {quote(pattern)}, {found}, {NO_MATCHES})"


def first_of_each(rows: str, key: str) -> str:
    """The first element of each value of ``key``, an expression over the element ``x``, in order."""
    return bound(rows, "a", bound(f"transform(a, x -> {key})", "k", "transform(array_distinct(k), d -> a[CAST(array_position(k, d) AS int) - 1])"))


def evidence(m: str, most: int = 150) -> str:
    """The sentence around a match."""
    left = f"substring_index(translate({m}.before, '.!?\\n', '{_END * 4}'), '{_END}', -1)"
    right = f"regexp_extract({m}.after, {quote(r'^[^.!?' + chr(92) + r'n]*[.!?]?')}, 0)"
    return f"left(trim(concat({left}, {m}.match, {right})), {most})"


def first_upper(c: str) -> str:
    return f"concat(upper(left({c}, 1)), substr({c}, 2))"
