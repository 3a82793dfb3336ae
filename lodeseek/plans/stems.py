"""The stemming tokenizer in SQL, written by its own rules as expressions: it checks the operator's without sharing its code."""

from __future__ import annotations

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"

# The suffixes of steps 2, 3 and 4 of Porter's published algorithm and what replaces them.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _m_over_0(x: str) -> str:
    return f"regexp_matches({x}, '^({_C})?{_V}{_C}')"


def _m_over_1(x: str) -> str:
    return f"regexp_matches({x}, '^({_C})?{_V}{_C}{_V}{_C}')"


def _m_is_1(x: str) -> str:
    return f"regexp_matches({x}, '^({_C})?{_V}{_C}({_V})?$')"


def _has_vowel(x: str) -> str:
    return f"regexp_matches({x}, '^({_C})?[aeiouy]')"


def _short(x: str) -> str:
    return f"regexp_matches({x}, '^{_C}[aeiouy][^aeiouwxy]$')"


def _but(n: int) -> str:
    return f"left(w, -{n})"


def _suffixes(pairs: dict[str, str]) -> str:
    cases = " ".join(f"when ends_with(w, '{s}') and length(w) > {len(s)} then case when {_m_over_0(_but(len(s)))} then {_but(len(s))} || '{n}' else w end" for s, n in sorted(pairs.items(), key=lambda p: -len(p[0])))
    return f"case {cases} else w end"


def _step4() -> str:
    cases = " ".join(
        f"when ends_with(w, '{s}') and length(w) > {len(s)} then case when {_m_over_1(_but(len(s)))}" + (f" and right({_but(3)}, 1) in ('s', 't')" if s == "ion" else "") + f" then {_but(len(s))} else w end" for s in sorted(_STEP4, key=len, reverse=True)
    )
    return f"case {cases} else w end"


_STEPS = (
    "case when (ends_with(w, 'sses') and length(w) > 4) or (ends_with(w, 'ies') and length(w) > 3) then left(w, -2) when ends_with(w, 's') and not ends_with(w, 'ss') then left(w, -1) else w end",
    f"""case when ends_with(w, 'eed') and length(w) > 3 then case when {_m_over_0(_but(3))} then left(w, -1) else w end
      when ends_with(w, 'ed') and {_has_vowel(_but(2))} then '+' || left(w, -2) when ends_with(w, 'ing') and {_has_vowel(_but(3))} then '+' || left(w, -3) else w end""",
    f"""case when not starts_with(w, '+') then w when regexp_matches(w, '(at|bl|iz)$') then substring(w, 2) || 'e'
      when length(w) > 2 and right(w, 1) = left(right(w, 2), 1) and not regexp_matches(w, '[aeiou]$') then case when regexp_matches(w, '[lsz]$') then substring(w, 2) else substring(left(w, -1), 2) end
      when {_m_is_1('substring(w, 2)')} and {_short('substring(w, 2)')} then substring(w, 2) || 'e' else substring(w, 2) end""",
    f"case when ends_with(w, 'y') and {_has_vowel(_but(1))} then left(w, -1) || 'i' else w end",
    _suffixes(_STEP2),
    _suffixes(_STEP3),
    _step4(),
    f"case when ends_with(w, 'e') and ({_m_over_1(_but(1))} or ({_m_is_1(_but(1))} and not {_short(_but(1))})) then left(w, -1) else w end",
    f"case when ends_with(w, 'll') and {_m_over_1('w')} then left(w, -1) else w end",
)


def folded(text: str) -> str:
    """Lower case, without diacritics and marks."""
    return f"regexp_replace(strip_accents(lower(coalesce({text}, ''))), '\\p{{M}}', '', 'g')"


def words(text: str) -> str:
    """The unstemmed words of a text as a list."""
    return f"regexp_extract_all({folded(text)}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def stems(source: str, name: str = "stems") -> str:
    """CTEs that end in `name` (word, term) for all distinct words of `source` (a query with one column, word)."""
    out = [f"{name}_0 as (select distinct word, case when starts_with(word, 'y') then 'Y' || substring(word, 2) else word end w from ({source}))"]
    for k, step in enumerate(_STEPS, 1):
        guard = f"case when octet_length(encode(word)) between 3 and 64 then {step} else w end" if k == 1 else f"case when octet_length(encode(word)) between 3 and 64 and (octet_length(encode(w)) >= 1) then {step} else w end"
        out.append(f"{name}_{k} as materialized (select word, {guard} w from {name}_{k - 1})")
    out.append(f"{name} as (select word, replace(w, 'Y', 'y') term from {name}_{len(_STEPS)})")
    return ",\n".join(out)
