"""Operator 2, quality rules: line-first cleaning.

Every line with words is judged by itself: navigation (mostly ``|``), symbols
(more than one of ``#*$%&|<>`` per word), exclamation (more than one ``!`` per
two words), missing punctuation (a long ASCII line without ``.?!,;:``) and
boilerplate (a stock phrase in a short line, or a line equal to an earlier
one). Failing lines are removed; a document that loses more than ``max_loss``
per cent of its word characters is rejected, and so is one that fails the base
rules (too few words, too many words inside repeated 5-word windows).

One streamed pass without a shuffle: each row is decided from its own text.

Defined results: a null or empty text has no words and is rejected with zeros
and a null clean text; a null doc_id stays null; repeated rows are judged row
by row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import doc_texts, map_batches, table


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5
    nav_pct: int = 20
    exclaim_pct: int = 50
    unpunctuated_words: int = 30
    phrase_words: int = 30
    max_loss: int = 50
    phrases: tuple[str, ...] = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here", "lorem ipsum",
        "alle rechte vorbehalten", "nutzungsbedingungen", "hier klicken", "tous droits réservés", "politique de confidentialité", "mentions légales", "cliquez ici", "todos los derechos reservados", "política de privacidad", "términos de uso", "haga clic aquí")


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_bad_lines long, kept_chars long, clean_text string"
_SYMBOLS, _PUNCT = K.lut(b"#*$%&|<>"), K.lut(b".?!,;:")


#: Marks beyond ASCII, as many bytes as they have: ellipsis, ideographic and full-width stops and commas, Arabic comma and question mark.
WIDE_MARKS = "…。、，！？：；،؛؟"


def _wide_marks(b: np.ndarray) -> np.ndarray:
    """Flags of the bytes where such a mark begins."""
    out = np.zeros(len(b), bool)
    if (b >= 128).any():
        for mark in WIDE_MARKS:
            raw = mark.encode()
            at = np.flatnonzero(b[: max(0, len(b) - len(raw) + 1)] == raw[0])
            for k in range(1, len(raw)):
                at = at[b[at + k] == raw[k]]
            out[at] = True
    return out


def _judge(c: K.Chunk, r: QualityRules) -> dict[str, np.ndarray | list]:
    w = c.words(K.SPACE_WORD, lower=False)
    rows = w.rows()
    lead = K.SPACE_WORD[c.buf] & K.LEADS[c.buf]
    word_chars = c.per_row(lead)
    gram, at = w.grams(r.window)
    again = np.zeros(len(w.key), bool)
    if len(at):
        first = at[K.repeated(K.mix(gram ^ (rows[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))))]
        again = K.covered(first, r.window, len(w.key))
    n_repeat = K.span_sums(again, w.offs)

    start, end, line_offs = c.lines()
    edge = np.append(start, len(c.buf))  # lines are sorted and cover the buffer but for line feeds
    line_words = np.diff(np.searchsorted(w.start, edge))
    sums = lambda flags: K.span_sums(flags, edge)  # noqa: E731  line feeds between carry no flag
    has = line_words > 0
    line_row = np.repeat(np.arange(c.n), np.diff(line_offs))
    key = K.span_hash(K.prefix_hash(K.BYTE_CODE[c.buf]), start, end) ^ (line_row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    at = np.flatnonzero(has)
    order = at[np.argsort(key[at], kind="stable")]
    dup = np.zeros(len(start), bool)
    dup[order[1:][key[order[1:]] == key[order[:-1]]]] = True

    bad = dup.copy()
    bad |= 100 * sums(c.buf == 124) >= r.nav_pct * line_words
    bad |= sums(_SYMBOLS[c.buf]) > line_words
    bad |= 100 * sums(c.buf == 33) > r.exclaim_pct * line_words
    long_ = np.flatnonzero(line_words >= r.unpunctuated_words)
    if len(long_):
        plain = (sums(_PUNCT[c.buf]) == 0) & (sums(_wide_marks(c.buf)) == 0)
        bad[long_] |= plain[long_]
    low = K.LOWER[c.buf].tobytes()
    for phrase in r.phrases:
        find, p = phrase.encode(), -1
        while (p := low.find(find, p + 1)) >= 0:
            k = int(np.searchsorted(start, p, "right")) - 1
            if p + len(find) <= end[k] and line_words[k] <= r.phrase_words:
                bad[k] = True
    bad &= has
    line_chars = sums(lead)
    kept_chars = K.span_sums(np.where(bad, 0, line_chars), line_offs)
    failed = (w.count < r.min_words) | (100 * n_repeat > r.max_repeat_pct * w.count)
    kept = ~failed & (100 * (word_chars - kept_chars) <= r.max_loss * word_chars)
    n_bad = K.span_sums(bad, line_offs)
    clean: list[str | None] = [None] * c.n
    for i in np.flatnonzero(kept):
        if not n_bad[i]:
            clean[i] = c.buf[c.offs[i] : c.offs[i + 1]].tobytes().decode()
        else:
            clean[i] = b"\n".join(c.buf[start[k] : end[k]].tobytes() for k in range(line_offs[i], line_offs[i + 1]) if not bad[k]).decode()
    return {
        "n_words": w.count, "word_chars": word_chars, "n_symbols": c.per_row(_SYMBOLS[c.buf]), "n_dup_lines": K.span_sums(dup, line_offs),
        "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept, "n_lines": K.span_sums(has, line_offs), "n_bad_lines": n_bad, "kept_chars": kept_chars, "clean_text": clean,
    }


def judge_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row of docs (doc_id, text): measures, verdict, cleaned text (null if rejected)."""

    def run(b: pa.RecordBatch):
        for c in K.chunks(b.column(1)):
            got = _judge(c, rules)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(c.first, c.n), *(pa.array(v, pa.string() if k == "clean_text" else pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, v in got.items())],
                names=["doc_id", *got],
            )

    return map_batches(doc_texts(docs), run, SCHEMA)


def keep_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Docs' own columns, rejected rows gone, texts cleaned and n_chars (if there) brought up to date.

    Columns other than text pass through untouched, so names can't clash.
    """
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch):
        for c in K.chunks(b.column(at)):
            got = _judge(c, rules)
            keep = np.flatnonzero(got["kept"])
            if not len(keep):
                continue
            rows = b.slice(c.first, c.n).take(pa.array(keep))
            clean = [got["clean_text"][i] for i in keep]
            new = {"text": pa.array(clean, pa.string()), "n_chars": pa.array([len(t) for t in clean], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(name, rows.column(i)) for i, name in enumerate(rows.schema.names)], names=rows.schema.names)

    cast = {"text": F.col("text").cast("string")} | ({"n_chars": F.col("n_chars").cast("long")} if "n_chars" in docs.columns else {})
    d = docs.withColumns(cast)
    return map_batches(d, run, d.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge_quality(table(spark, sf_dir, "documents"))
    return got.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def cte_sql(r: QualityRules = QualityRules(), docs: str = "documents", p: str = "") -> str:
    """DuckDB: CTEs giving {p}judged(doc_id, measures, clean_text); rows are told apart by row number."""
    phrases = " or ".join(f"contains(low, '{x}')" for x in r.phrases)
    w = r.window
    return f"""
{p}src as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from {docs}),
{p}wl as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n from (select rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from {p}src)),
{p}gr as (select rid, i, n, hash(w) as h, [w{"".join(f", lead(w, {j}) over wd" for j in range(1, w))}] as g from {p}wl window wd as (partition by rid order by i)),
{p}rep as (select rid, i, case when i + {w - 1} <= n and count(*) over (partition by rid, g) > 1 then 1 else 0 end as again from {p}gr),
{p}rc as (select rid, sum(c) as n_repeat_words from (select rid, max(again) over (partition by rid order by i rows between {w - 1} preceding and current row) as c from {p}rep) group by rid),
{p}ln as (select rid, unnest(ls) as line, generate_subscripts(ls, 1) as k from (select rid, string_split(text, chr(10)) as ls from {p}src)),
{p}lm as (select *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as nw, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) as nc,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as ns, length(regexp_replace(line, '[^|]', '', 'g')) as np, length(regexp_replace(line, '[^!]', '', 'g')) as nx,
  translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, row_number() over (partition by rid, line order by k) > 1 as seen from {p}ln),
{p}lj as (select *, nw > 0 and seen as dup, nw > 0 and (seen or 100 * np >= {r.nav_pct} * nw or ns > nw or 100 * nx > {r.exclaim_pct} * nw
  or (nw >= {r.unpunctuated_words} and not regexp_matches(line, '[.?!,;:{WIDE_MARKS}]')) or (nw <= {r.phrase_words} and ({phrases}))) as bad from {p}lm),
{p}la as (select rid, sum(nw) as n_words, sum(nc) as word_chars, sum(ns) as n_symbols, count(*) filter (dup) as n_dup_lines, count(*) filter (nw > 0) as n_lines, count(*) filter (bad) as n_bad_lines,
  coalesce(sum(nc) filter (not bad), 0) as kept_chars, string_agg(line, chr(10) order by k) filter (not bad) as clean from {p}lj group by rid),
{p}lf as (select s.doc_id, s.rid, la.*, coalesce(n_repeat_words, 0) as n_rep, n_words < {r.min_words} or 100 * coalesce(n_repeat_words, 0) > {r.max_repeat_pct} * n_words as base_failed
  from {p}src s join {p}la la using (rid) left join {p}rc using (rid)),
{p}judged as (select rid, doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines, n_rep::bigint as n_repeat_words, base_failed,
  not base_failed and 100 * (word_chars - kept_chars) <= {r.max_loss} * word_chars as kept, n_lines, n_bad_lines, kept_chars::bigint as kept_chars,
  case when not base_failed and 100 * (word_chars - kept_chars) <= {r.max_loss} * word_chars then clean end as clean_text from {p}lf)"""


def oracle() -> str:
    return f"with {cte_sql().strip()} select * exclude (rid, clean_text), sha256(clean_text) as clean_sha256 from judged"
