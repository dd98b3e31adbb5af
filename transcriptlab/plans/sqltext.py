"""Pieces of SQL that say what the column builders of texts say."""

from __future__ import annotations

from ..functions import meaning as M
from ..functions import texts as X


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]" + ("" if values else "::VARCHAR[]")


def plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9+# ]+', ' ', 'g'), ' +', ' ', 'g'))"


def table(known: dict[str, tuple[str, ...]]) -> str:
    return "MAP{" + ", ".join(f"{quoted(k)}: {listed(v)}" for k, v in known.items()) + "}"


def concepts(words: str) -> str:
    """Concepts and long words of a list of lower-case words."""
    joined = f"' ' || array_to_string({words}, ' ') || ' '"
    tests = []
    for i, (name, (forms, phrases, parts)) in enumerate(M.CONCEPTS.items()):
        any_of = [f"list_has_any({words}, {listed(forms.split())})"] if forms else []
        any_of += [f"contains({joined}, {quoted(f' {p} ')})" for p in phrases.split(",") if p] + [f"contains({joined}, {quoted(p)})" for p in parts.split(",") if p]
        any_of += [f"len(list_filter({words}, lambda z: starts_with(z, '{M.STEM}'))) > 0"] if i == 0 else []
        tests.append(f"CASE WHEN {' OR '.join(any_of)} THEN '{name}' END")
    stop = ", ".join(map(quoted, M.STOP_WORDS))
    return f"list_distinct(list_concat(list_filter([{', '.join(tests)}], lambda z: z IS NOT NULL), list_filter({words}, lambda z: length(z) > 4 AND z NOT IN ({stop}))))"


def anchors(text: str) -> str:
    stop, known = ", ".join(map(quoted, M.ANCHOR_STOP_WORDS)), ", ".join(map(quoted, M.ALIASES))
    found = f"list_transform(regexp_extract_all({text}, {quoted(M.TERM)}), lambda z: {{'k': {plain('z')}, 'w': z}})"
    kept = f"z.k <> '' AND z.k NOT IN ({stop}) AND (length(z.k) >= 4 OR (upper(z.w) = z.w AND regexp_matches(z.w, '[A-Za-z]')) OR z.k IN ({known}))"
    return f"list_distinct(list_transform(list_filter({found}, lambda z: {kept}), lambda z: z.k))"


def word_said(n: str) -> str:
    """Whether one of the variants of a plain term stands in ``said``."""
    other = f"CASE WHEN {n} LIKE '%s' AND length({n}) > 3 THEN left({n}, -1) ELSE {n} || 's' END"
    single = f"({n} LIKE '%ies' AND length({n}) > 4 AND contains(said, ' ' || left({n}, -3) || 'y ')) OR ({n} LIKE '%es' AND length({n}) > 3 AND contains(said, ' ' || left({n}, -2) || ' ')) OR contains(said, ' ' || {other} || ' ')"
    return f"{n} <> '' AND (contains(said, ' ' || {n} || ' ') OR (NOT contains({n}, ' ') AND ({single})))"


def hit(term: str) -> str:
    """Whether a term is heard, in any of its ways of writing; ``said`` and ``raw`` are columns."""
    ways = f"list_concat(coalesce({table(M.ALIASES)}[{term}], [{term}]), coalesce({table(M.SPELLINGS)}[{term}], []::VARCHAR[]))"
    keyed = f"list_transform({ways}, lambda y: {{'n': {plain('y')}, 'y': lower(y)}})"
    return f"len(list_filter({keyed}, lambda y: CASE WHEN regexp_matches(y.y, '[\\x{{0900}}-\\x{{097F}}]') THEN contains(raw, y.y) ELSE {word_said('y.n')} END)) > 0"


def critical(actual: str, flags: str) -> str:
    said = f"lower(trim({actual}))"
    return f"({said} LIKE '{M.FAILED_START}%' OR {said} IN ({', '.join(map(quoted, M.FAILED_TEXTS))}) OR list_has_any(regexp_split_to_array(lower(coalesce({flags}, '')), '[,;\\s]+'), {listed(M.CRITICAL_FLAGS)}))"


def scripts(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{n}' END" for n, p in M.SCRIPTS.items()) + "], lambda z: z IS NOT NULL)"


def language(gold: str, actual: str) -> str:
    want = scripts(gold)
    return f"CASE WHEN len({want}) = 0 THEN 1.0 ELSE len(list_intersect({want}, {scripts(actual)}))::DOUBLE / len({want}) END"


def mixed(category: str, gold: str) -> str:
    return f"(regexp_matches(lower({category}), '{'|'.join(M.MIXED_CATEGORIES)}') OR regexp_matches({gold}, '[\\x{{0900}}-\\x{{097F}}\\x{{4E00}}-\\x{{9FFF}}]'))"


def spoken(text: str) -> str:
    """Lower case, short negations written out, number words as digits, everything else than a-z and 0-9 a blank."""
    text = f"lower({text})"
    for verb, full in X.NEGATED.items():
        text = f"regexp_replace({text}, '\\b{verb} *n *[''’]? *t\\b', '{full} not', 'g')"
    text = f"regexp_replace({text}, '\\bcannot\\b', 'can not', 'g')"
    for word, digits in X.NUMBERS.items():
        text = f"replace({text}, '{word}', '{digits}')"
    return f"trim(regexp_replace({text}, '[^a-z0-9]+', ' ', 'g'))"


BLANKS = "[\\x20\\x09-\\x0D]+"


def stripped(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '^{BLANKS}|{BLANKS}$', '', 'g')"


def spaced(text: str) -> str:
    return f"regexp_replace({stripped(text)}, '{BLANKS}', ' ', 'g')"
