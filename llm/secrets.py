"""Secrets in texts: known shapes by pattern, others by sliding-window entropy. DataFrame functions only.

Candidate strings are maximal runs of at least ``WINDOW`` base64 or URL
characters. A window of that many characters slides over each; its Shannon
entropy follows from counts per character that change by one character in and
one out: H = log2(W) - (sum of c*log2(c)) / W. The class of the candidate (hex,
letters and digits, base64) sets the threshold. A candidate is suppressed if an
allow-list pattern fits it; the patterns of known shapes are never suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# kind, pattern, group whose length counts, least length of that group: fixed shapes
KNOWN = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# the same matches after the length filter, for patterns whose greedy run can't hold another match
SHORTER = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
KINDS = [k for k, *_ in KNOWN] + ["entropy"]

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# least entropy in bits of a window, by class; 20 characters have at most 4.32
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
ALLOWED = [
    r"^[^0-9]*$",                                                          # words and lines
    r"^[0-9_=-]*$",                                                        # numbers, dates, rules
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)example|placeholder|your[_-]|x{6}",                              # documentation
    r"^/?([a-z_]+[0-9]{0,3}/)+[a-z_0-9-]*$",                               # paths
]

_SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """Text between matches, match and group, in order; the last element has no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))


def _spans(zipped: str, kind: str, least: int) -> Column:
    """Positions are running sums of lengths, in code points."""
    return F.expr(f"""aggregate({zipped},
        named_struct('at', 0L, 'spans', cast(array() as array<{_SPAN}>)),
        (a, z) -> named_struct(
            'at', a.at + length(z.gap) + coalesce(length(z.hit), 0),
            'spans', if(coalesce(length(z.part), 0) >= {least},
                concat(a.spans, array(cast(named_struct('start', a.at + length(z.gap), 'rank', {KINDS.index(kind)},
                    'kind', '{kind}', 'end', a.at + length(z.gap) + length(z.hit)) as {_SPAN}))), a.spans)),
        a -> a.spans)""")


def _candidates(zipped: str) -> Column:
    return F.expr(f"""aggregate({zipped},
        named_struct('at', 0L, 'found', cast(array() as array<struct<start:bigint,word:string>>)),
        (a, z) -> named_struct('at', a.at + length(z.gap) + coalesce(length(z.hit), 0),
            'found', if(z.hit is not null, concat(a.found, array(named_struct('start', a.at + length(z.gap), 'word', z.hit))),
                a.found)),
        a -> a.found)""")


def _entropy(window: int, thresholds: dict[str, float], allowed: list[str]) -> tuple[Column, str]:
    """Spans from the first to the last window over the threshold of each candidate in ``_candidates``."""
    terms = ", ".join(repr(float(c * math.log2(c)) if c else 0.0) + "D" for c in range(window + 1))
    kept = F.filter("_candidates", lambda c: ~_any(c["word"], allowed))
    scored = F.transform(kept, lambda c: F.struct(
        c["start"].alias("start"), c["word"].alias("word"),
        (F.when(c["word"].rlike("^[0-9a-fA-F]+$"), thresholds["hex"])
         .when(c["word"].rlike("^[0-9A-Za-z]+$"), thresholds["alnum"]).otherwise(thresholds["base64"])).alias("least")))
    return scored, f"""filter(transform(_scored, c -> named_struct('start', c.start, 'seen', aggregate(
        flatten(transform(sequence(1, length(c.word)), i -> if(i > {window},
            array(named_struct('i', i, 'by', -1, 'k', instr('{ALPHABET}', substring(c.word, i - {window}, 1))),
                  named_struct('i', i, 'by', 1, 'k', instr('{ALPHABET}', substring(c.word, i, 1)))),
            array(named_struct('i', i, 'by', 1, 'k', instr('{ALPHABET}', substring(c.word, i, 1))))))),
        named_struct('counts', array_repeat(0, {len(ALPHABET)}), 'sum', 0D, 'first', 0, 'last', 0),
        (a, e) -> transform(array(named_struct(
                'old', a.counts[e.k - 1],
                'sum', a.sum + array({terms})[a.counts[e.k - 1] + e.by] - array({terms})[a.counts[e.k - 1]])), n ->
            named_struct(
                'counts', concat(slice(a.counts, 1, e.k - 1), array(n.old + e.by), slice(a.counts, e.k + 1, {len(ALPHABET)})),
                'sum', n.sum,
                'first', if(a.first = 0 and e.by = 1 and e.i >= {window}
                            and {math.log2(window)!r}D - n.sum / {window} >= c.least, e.i, a.first),
                'last', if(e.by = 1 and e.i >= {window}
                           and {math.log2(window)!r}D - n.sum / {window} >= c.least, e.i, a.last)))[0]))),
        x -> x.seen.first > 0)"""


def _any(word: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | word.rlike(pattern)
    return found


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] = (), window: int = WINDOW,
         thresholds: dict[str, float] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """(key, ``keep`` columns, _text, spans): spans are structs start, rank, kind, end in code points, end exclusive.

    Spans are ordered by start, then by kind as in KINDS. A null or empty text
    has no spans; every row stays, repeated or with a null key, on its own; no
    row meets another. Other columns are left out unless named in ``keep``.
    Long texts are scanned whole.
    """
    thresholds, allowed = thresholds or THRESHOLDS, ALLOWED if allowed is None else allowed
    rows = docs.select(docs[key].alias(key), *[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias("_text"))
    at = F.col("_text")
    for kind, pattern, group, _ in KNOWN:
        pattern = SHORTER.get(kind, pattern)
        rows = rows.withColumn(f"_z_{kind}", F.when(at.rlike(pattern), _pieces(at, pattern, group)))
    run = "[A-Za-z0-9+/_=-]{%d,}" % window
    rows = rows.withColumn("_z_run", F.when(at.rlike(run), _pieces(at, run, 0)))
    found = [F.coalesce(_spans(f"_z_{kind}", kind, least), F.expr(f"cast(array() as array<{_SPAN}>)"))
             for kind, _, _, least in KNOWN]
    rows = rows.withColumn("_known", F.concat(*found)).withColumn("_candidates", _candidates("_z_run"))
    scored, sliding = _entropy(window, thresholds, allowed)
    rows = rows.withColumn("_scored", scored).withColumn("_slid", F.expr(sliding))
    more = F.expr(f"""transform(_slid, x -> cast(named_struct('start', x.start + x.seen.first - {window},
        'rank', {KINDS.index('entropy')}, 'kind', 'entropy', 'end', x.start + x.seen.last) as {_SPAN}))""")
    spans = F.array_sort(F.concat("_known", F.coalesce(more, F.expr(f"cast(array() as array<{_SPAN}>)"))))
    return rows.select(key, *keep, "_text", spans.alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", **settings) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping spans by one mark; a null text stays null.

    All columns stay but for the text, in their order.
    """
    held = docs.withColumn("_row", F.struct(*[docs[c] for c in docs.columns]))
    found = scan(held, key, text, ["_row"], **settings).withColumn("_mark", F.lit(mark))
    clean = F.expr("""aggregate(spans, named_struct('at', 0L, 'out', ''),
        (a, s) -> named_struct('at', greatest(a.at, s.end),
            'out', if(s.start >= a.at, concat(a.out, substring(_text, int(a.at) + 1, int(s.start - a.at)), _mark), a.out)),
        a -> concat(a.out, substring(_text, int(a.at) + 1)))""")
    clean = F.when(F.size("spans") > 0, clean).otherwise(F.col(f"_row.`{text}`"))
    return found.select(*[clean.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
