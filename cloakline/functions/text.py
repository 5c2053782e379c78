"""Column-level text functions (SC-4 .. SC-21), all JVM-side built-ins.

Every function takes and returns ``Column`` objects so that it stays inside
whole-stage code generation; none of them calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakline import constants as C

# --- FIXED VALUES: the whitespace set of a no-argument Python ``str.split`` ---
WHITESPACE_RUN = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(x) -> Column:
    """SC-6 token list: lower case, split on whitespace runs, no empty tokens."""
    return F.filter(F.split(F.lower(_c(x)), WHITESPACE_RUN, -1), lambda t: t != F.lit(""))


def token_set(x) -> Column:
    """SC-6 token set (distinct tokens)."""
    return F.array_distinct(tokens(x))


# --- FIXED VALUES: the same whitespace set as characters, for trimming ---
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(x) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace (linear ``trim``)."""
    return F.trim(_c(x), F.lit(WHITESPACE_CHARS))


def utility_from_tokens(orig_tokens, masked_set) -> Column:
    """SC-7 on pre-computed token columns (original token list, masked token set)."""
    o = F.array_distinct(_c(orig_tokens))
    return F.when(F.size(o) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(o, _c(masked_set))).cast("double") / F.size(o))


def quasi_from_tokens(orig_tokens, masked_set) -> Column:
    """SC-9 on pre-computed token columns, near-linear per row.

    ``E = array_except(tokens, masked_set)`` (hash based) holds the distinct
    original tokens missing from the masked text: only the few that the
    masking removed.  Tokens found in the masked set are then all tokens
    minus the occurrences of ``E`` members, so the per-token membership scan
    runs over ``E`` instead of the whole masked vocabulary.  ``E`` rides in
    the fold accumulator (built once per row).
    """
    t = _c(orig_tokens)
    init = F.struct(F.array_except(t, _c(masked_set)).alias("e"), F.lit(0).alias("n"))
    n_out = F.aggregate(t, init, lambda acc, x: F.struct(
        acc["e"].alias("e"), (acc["n"] + F.when(F.array_contains(acc["e"], x), 1).otherwise(0)).alias("n")),
        lambda acc: acc["n"])
    return F.when(F.size(t) == 0, F.lit(0.0)).otherwise((F.size(t) - n_out).cast("double") / F.size(t))


def utility(original, masked) -> Column:
    """SC-7: share of distinct original tokens still present; 1.0 if none."""
    o = token_set(original)
    m = token_set(masked)
    return F.when(F.size(o) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(o, m)).cast("double") / F.size(o)
    )


def quasi_risk(original, masked) -> Column:
    """SC-9: share of original tokens (with repeats) in the masked token set."""
    return quasi_from_tokens(tokens(original), token_set(masked))


def exact_leakage(masked, gt_spans) -> Column:
    """SC-12: some non-empty truth text occurs verbatim in the masked text."""
    m = _c(masked)
    return F.exists(_c(gt_spans), lambda g: (g != F.lit("")) & F.contains(m, g))


def shares_token(a, b) -> Column:
    """SC-13: two texts share a lower-case token."""
    return F.coalesce(F.arrays_overlap(token_set(a), token_set(b)), F.lit(False))


def cap_words(x, n: int = C.ABSTRACT_PHRASE_MAX_WORDS) -> Column:
    """SC-14: strip, then keep only the first ``n`` words when longer."""
    s = strip(x)
    words = F.filter(F.split(s, WHITESPACE_RUN, -1), lambda t: t != F.lit(""))
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(s)


def token_text(token_id) -> Column:
    """SC-15: ``<<ENC:`` id ``:ENC>>``."""
    return F.concat(F.lit(C.ENCRYPT_MARKER), _c(token_id), F.lit(C.ENCRYPT_END))


TOKEN_REGEX = r"<<ENC:([^:]+):ENC>>"


def learned_label(phi_type, span) -> Column:
    """SC-16: type + ``_`` + first 8 characters with spaces as ``_``."""
    return F.concat(
        _c(phi_type), F.lit("_"),
        F.replace(F.substring(_c(span), 1, C.LEARNED_LABEL_PREFIX_CHARS), F.lit(" "), F.lit("_")),
    )


def route(phi_type) -> Column:
    """PRJ-1: encrypt set decides; everything else is abstracted."""
    return F.when(F.upper(_c(phi_type)).isin(*C.ENCRYPT_TYPES), F.lit("encrypt")).otherwise(F.lit("abstract"))
