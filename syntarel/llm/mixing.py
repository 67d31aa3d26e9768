"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Raking scales the cells'
token weights to the target share of each source, each language and each topic in
turn until all margins hold to TOLERANCE; where targets contradict each other, so
that they can't hold, a warning gives the error that is left. A cell's sampling probability is its raked weight over
its tokens, times a factor that is calibrated so that the expected tokens make up
the wanted part of the corpus, none being taken more than once.

Only DataFrame functions run here. Topics and tokens are found in one scan of the texts
and written with the rows. The cells are a table of sums, which a margin's sums are joined
to, so that neither a margin's value nor all cells need to fit one task; only single
numbers reach the driver.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleared, id_text, materialize, release

MARGINS = ("source", "lang", "topic")
#: A document's topic is the first whose pattern it holds (name, pattern).
TOPICS = [("legal", "(?i)licen[sc]e|copyright|all rights reserved"), ("credentials", r"(?i)token\s*=|secret|password|api[_-]?key"), ("contact", r"[\w.+-]+@[\w-]+\.\w+"), ("table", r" \| ")]
OTHER = "general"
#: Without targets, a margin's shares are its token shares to this power, normed.
TEMPER = 0.7
#: Sweeps over the three margins at least, and part of the tokens that is kept.
SWEEPS, KEEP = 15, 0.6
#: Largest relative error of a margin at which raking stops. It gives up, with a warning, where STEP sweeps
#: take off less than a thousandth of the error, or after MOST_SWEEPS.
TOLERANCE, STEP, MOST_SWEEPS = 1e-6, 5, 5000


def topic_of(text: Column, topics: list[tuple[str, str]] | None = None) -> Column:
    """The first topic whose pattern occurs in the text, else ``general``."""
    cases = None
    for name, pattern in TOPICS if topics is None else topics:
        cases = (F if cases is None else cases).when(text.rlike(pattern), F.lit(name))
    return F.lit(OTHER) if cases is None else cases.otherwise(OTHER)


def tokens_of(text: Column) -> Column:
    """Words (runs of anything but the six ASCII white spaces) of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_cells(docs: DataFrame, topics: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``__source``, ``__lang``, ``__topic`` (a null counts as the empty string)."""
    return docs.withColumns({"__source": F.coalesce(F.col("source").cast("string"), F.lit("")), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "__topic": F.coalesce(topic_of(F.col("text"), topics), F.lit(OTHER))})


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, temper: float = TEMPER) -> DataFrame:
    """Adds ``weight`` to the cells (``source, lang, topic, tokens``): shares that meet the margins' targets.

    ``targets`` maps a margin to its values' shares; a value it doesn't name
    shares the rest by its tokens. A margin without targets is tempered. After
    ``sweeps`` sweeps, more follow until all margins hold to TOLERANCE.
    """
    some = cells.where("tokens > 0")
    total = float(some.agg(F.sum("tokens")).first()[0] or 1)
    df = some.withColumn("weight", F.col("tokens") / F.lit(total))
    for margin in MARGINS:
        values = materialize(df.groupBy(margin).agg(F.sum("weight").alias("share")), "shares")
        named = (targets or {}).get(margin)
        if named is None:
            raw = F.pow("share", F.lit(temper))
        else:
            given = F.coalesce(*[F.when(F.col(margin) == k, F.lit(float(v))) for k, v in named.items()], F.lit(None).cast("double"))
            rest = max(0.0, 1.0 - sum(map(float, named.values())))
            free = float(values.where(given.isNull()).agg(F.sum("share")).first()[0] or 1)
            raw = F.coalesce(given, F.lit(rest) * F.col("share") / F.lit(free))
        whole = float(values.agg(F.sum(raw)).first()[0] or 1)
        df = df.join(values.select(margin, (raw / F.lit(whole)).alias(f"want_{margin}")), margin)
    df = old = materialize(df, "cells")
    done, before = 0, float("inf")
    while True:
        for margin in MARGINS:
            sums = df.groupBy(margin).agg(F.sum("weight").alias("__sum"))
            # A cell that got no weight keeps none.
            df = df.join(sums, margin).withColumn("weight", F.when(F.col("weight") > 0, F.col("weight") * F.col(f"want_{margin}") / F.col("__sum")).otherwise(0.0)).drop("__sum")
        new, done = materialize(df, "raked"), done + 1
        release(old)
        df = old = new
        if done < sweeps or (done - sweeps) % STEP:
            continue
        error = margin_error(df)
        if error <= TOLERANCE:
            break
        if error > before * 0.999 or done >= MOST_SWEEPS:
            warnings.warn(f"after {done} sweeps a margin is off its target by a factor of 1 +- {error:.3g}", stacklevel=2)
            break
        before = error
    return df.select(*MARGINS, "tokens", "weight")


def margin_error(df: DataFrame) -> float:
    """Largest error of a margin's sums of ``weight`` in relation to its targets ``want_...``; 0 without cells."""
    worst = 0.0
    for m in MARGINS:
        sums = df.groupBy(m).agg(F.sum("weight").alias("has"), F.first(f"want_{m}").alias("want")).where("want > 0")
        worst = max(worst, float(sums.agg(F.max(F.abs(F.col("has") / F.col("want") - 1))).first()[0] or 0.0))
    return worst


def calibrate(raked: DataFrame, keep: float = KEEP, most_steps: int = 60) -> DataFrame:
    """Adds ``rate`` (0 to 1): min(1, factor * weight / token share), the factor such that ``keep`` of all tokens is expected.

    Cells that reach 1 are taken whole and the factor is set anew for the
    others, until no more cells reach it.
    """
    total = raked.agg(F.sum("tokens")).first()[0]
    cells = materialize(raked.withColumn("ratio", F.col("weight") / (F.col("tokens") / F.lit(float(total or 1)))), "ratios")
    factor = 0.0
    for _ in range(most_steps if total else 0):
        full = F.col("ratio") * F.lit(factor) >= 1
        fixed, free = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("ratio")))).first()
        new = (keep * total - fixed) / free if free else factor
        if new <= factor * (1 + 1e-12):
            break
        factor = new
    return cells.withColumn("rate", F.least(F.lit(1.0), F.col("ratio") * F.lit(factor))).drop("ratio")


def chance(col: str = "doc_id") -> Column:
    """A number in [0, 1) that a document's id alone decides: 48 bits of its text's MD5."""
    return F.conv(F.substring(F.md5(id_text(col)), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topics: list[tuple[str, str]] | None = None, into: str = "mixing", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all, if None; doc_id must be one) of every row and struct ``into`` (topic, tokens, rate, taken).

    A row is taken if its id's number is below its cell's rate, so rows of one
    id in one cell share their fate and a rerun takes the same. Rows without
    words have rate 1 and are taken: they weigh nothing. Null sources and
    languages are cells of their own. An empty table gives an empty result.
    A column named ``into`` is replaced; ``__source``, ``__lang``, ``__topic``, ``__tokens`` and ``__rate`` mustn't be columns' names. What is returned is written once with its
    cells and read from there, so texts are looked at once.
    """
    names = [c for c in (columns or docs.columns) if c != into]
    own = with_cells(docs, topics).withColumn("__tokens", tokens_of(F.col("text")))
    own = materialize(own.select(*names, *[f"__{m}" for m in MARGINS], "__tokens"), "mixing")
    with cleared(docs.sparkSession) as stays:
        sums = materialize(own.groupBy(*[F.col(f"__{m}").alias(m) for m in MARGINS]).agg(F.sum("__tokens").alias("tokens")), "sums")
        rates = stays(materialize(calibrate(rake(sums, targets), keep).select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("rate").alias("__rate")), "rates"))
    joined = own.join(rates, [f"__{m}" for m in MARGINS], "left")
    joined = joined.withColumn("__rate", F.when(F.col("__tokens") > 0, F.coalesce("__rate", F.lit(1.0))).otherwise(1.0))
    fields = F.struct(F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.col("__rate").alias("rate"), (chance() < F.col("__rate")).alias("taken"))
    return joined.select(*names, fields.alias(into))


def mixing_sql(table: str = "documents", sweeps: int = SWEEPS, temper: float = TEMPER, keep: float = KEEP, steps: int = 12) -> str:
    """DuckDB statement for :func:`mix` without targets: doc_id, source, lang, topic, tokens, rate (6 digits), taken."""
    # The patterns as DuckDB writes them.
    topic = "case " + " ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in TOPICS) + f" else '{OTHER}' end"
    parts = [
        rf"d as (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang, coalesce({topic}, '{OTHER}') topic, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint tokens from {table})",
        "c as (select source, lang, topic, sum(tokens)::double tokens from d group by all having sum(tokens) > 0)",
        "w0 as (select *, tokens / sum(tokens) over () weight from c)",
    ]
    for m in MARGINS:
        parts.append(f"t_{m} as (select {m}, raw / sum(raw) over () want_{m} from (select {m}, pow(sum(weight), {temper}) raw from w0 group by {m}))")
    parts.append("r0 as (select * from w0 " + " ".join(f"join t_{m} using ({m})" for m in MARGINS) + ")")
    k = 0
    for _ in range(sweeps):
        for m in MARGINS:
            parts.append(f"r{k + 1} as materialized (select * replace (weight * want_{m} / sum(weight) over (partition by {m}) as weight) from r{k})")
            k += 1
    parts += [f"q as materialized (select source, lang, topic, tokens, weight / (tokens / sum(tokens) over ()) ratio from r{k})", "f0 as (select 0.0::double factor)"]
    for i in range(steps):
        parts.append(f"f{i + 1} as materialized (select coalesce(greatest(factor, ({keep}::double * sum(tokens) - sum(case when ratio * factor >= 1 then tokens else 0 end)) / nullif(sum(case when ratio * factor >= 1 then 0 else tokens * ratio end), 0)), factor) factor from q, f{i} group by factor)")
    return (
        "with " + ", ".join(parts) + f" select doc_id, source, lang, topic, tokens, round(rate, 6) rate, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint / 281474976710656.0::double) < rate taken"
        f" from (select d.*, case when d.tokens > 0 then least(1.0::double, ratio * factor) else 1.0::double end rate from d left join q using (source, lang, topic), f{steps})"
    )
