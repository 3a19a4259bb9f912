"""Text rules as SQL snippets for the checking database."""

from ..functions import patterns as P


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The pattern as a literal the checking database understands (it lacks lookaround)."""
    return quoted(
        pattern.replace(P.WORD_START, r"\b").replace(P.WORD_END, r"\b").replace("(?U)", "")
    )


def matched(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {re2(pattern)}, {group}), '')"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def normalize(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({text}), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"


def title_key(text: str) -> str:
    return strip(rf"regexp_replace(lower({text}), '[^\w\s]', '', 'g')")


def long_words(key: str) -> str:
    return rf"list_filter(regexp_split_to_array({key}, '\s+'), lambda w: length(w) > 2)"


def title_similarity(a: str, b: str, l: str, r: str) -> str:
    """Likeness of raw titles ``a`` and ``b`` whose keys are ``l`` and ``r``."""
    wl, wr = long_words(l), long_words(r)
    overlap = f"len(list_filter({wl}, lambda w: list_contains({wr}, w))) * 2.0 / (len({wl}) + len({wr}))"
    start = f"least(length({l}), length({r}), 30)"
    return f"""case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then 0.0
      when {l} = {r} then 1.0
      when contains(case when length({l}) < length({r}) then {r} else {l} end,
                    case when length({l}) < length({r}) then {l} else {r} end)
        then least(length({l}), length({r})) / greatest(length({l}), length({r}))::double
      when len({wl}) = 0 or len({wr}) = 0 then 0.0
      when {start} >= 10 and substring({l}, 1, {start}) = substring({r}, 1, {start}) then greatest({overlap}, 0.7)
      else {overlap} end"""


def trigrams(text: str) -> str:
    words = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"
    return (
        f"list_sort(list_distinct(flatten(list_transform({words}, lambda w: "
        "list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))))"
    )


def jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"{common} / (len({a}) + len({b}) - {common})::double"


def score_text(score: str) -> str:
    return rf"regexp_replace(cast({score} as varchar), '\.0$', '')"


def notes(*items: str, separator: str = "; ") -> str:
    inner = ", ".join(items)
    return f"array_to_string(list_filter([{inner}], lambda n: n is not null), '{separator}')"
