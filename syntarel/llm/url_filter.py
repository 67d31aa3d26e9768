"""URL filters by the ratio of two character language models.

URLs that a rule accepts and URLs that a rule rejects each train a Markov
model over 40 symbols. The order varies: a symbol is predicted from the
longest context of up to three symbols that training has met often enough,
each order's estimate being smoothed towards the next shorter one. A URL's
score is the length-normalised difference of its log-likelihoods, and the
threshold is calibrated on ruled URLs that the models haven't seen.

Only DataFrame functions run here. A context's 40 log-ratios are one row, so a
model has at most 1 + 40 + 40^2 + 40^3 rows of 40 floats; it is held as one
row of arrays (11 MB at most) and looked up by position, without a shuffle of
the URLs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, cleared, let, materialize

#: Symbols by code: letters, digits, slash, dot, hyphen; code 39 is any other character and the padding before a URL.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789/.-"
N = len(SYMBOLS) + 1
ORDER = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there's none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there's no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest of ``rules`` that fits; null if none does."""
    cases = None
    for verdict, rule in sorted(rules, key=lambda x: -len(x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        cases = (F if cases is None else cases).when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return cases if cases is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def symbols_of(url: Column) -> Column:
    """Codes (0 to 39) of the URL's characters, scheme left out and A-Z lower-cased."""
    bare = F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[^/?#]*?://", ""), UPPER, LOWER)
    codes = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), _code)
    return codes


def _code(c: Column) -> Column:
    at = F.instr(F.lit(SYMBOLS), c)
    return F.when(at == 0, F.lit(N - 1)).otherwise(at - 1)


def train_url_models(ruled: DataFrame, least: int = 4, strength: float = 4.0) -> DataFrame:
    """One row of arrays m0..m3 from columns url and accepted (boolean).

    ``m<k>[context]`` is an array of 40 log-ratios (accepted over rejected) for
    the next symbol, null where training has met the context of k symbols less
    than ``least`` times. All rows count, repeated ones too. With no ruled URL
    of a kind its model is uniform.
    """
    symbols = ruled.select("accepted", symbols_of(F.col("url")).alias("s"))
    pad = F.array_repeat(F.lit(N - 1), ORDER)
    grams = symbols.select("accepted", F.concat(pad, "s").alias("s"), F.size("s").alias("n")).where("n > 0").select("accepted", F.explode(F.transform(F.sequence(F.lit(ORDER), F.col("n") + (ORDER - 1)), lambda i: reduce(lambda a, k: a * N + F.col("s")[i - k], range(ORDER, -1, -1), F.lit(0)))).alias("gram"))
    # One count of the longest grams serves all orders; N^4 rows at most.
    counts = materialize(grams.groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")), "url-grams")
    models = None
    for order in range(ORDER + 1):
        own = counts.select((F.col("gram") % N**(order + 1)).alias("g"), "a", "r").select((F.col("g") / N).cast("long").alias("context"), (F.col("g") % N).cast("int").alias("c"), "a", "r")
        cells = own.groupBy("context").agg(*[F.sum(F.when(F.col("c") == i, F.col(x)).otherwise(0)).alias(f"{x}{i}") for x in "ar" for i in range(N)])
        table = cells.select("context", F.array(*[F.col(f"a{i}").cast("double") for i in range(N)]).alias("na"), F.array(*[F.col(f"r{i}").cast("double") for i in range(N)]).alias("nr"))
        if order == 0:
            base = F.array_repeat(F.lit(1.0 / N), N)
            model = table.select("context", _smoothed("na", base, strength).alias("pa"), _smoothed("nr", base, strength).alias("pr"), F.lit(least).alias("met"))
        else:
            parent = models[-1].select(F.col("context").alias("parent"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            met = F.aggregate(F.zip_with("na", "nr", lambda x, y: x + y), F.lit(0.0), lambda s, x: s + x)
            model = table.withColumn("parent", F.col("context") % N ** (order - 1)).join(parent, "parent").select("context", _smoothed("na", F.col("qa"), strength).alias("pa"), _smoothed("nr", F.col("qr"), strength).alias("pr"), met.cast("int").alias("met"))
        model = materialize(model, f"url-order-{order}")
        models = [*(models or []), model]
    row = ruled.sparkSession.range(1).select(F.lit(0).alias("k"))
    for order, model in enumerate(models):
        ratio = model.where(F.col("met") >= least).select("context", F.zip_with("pa", "pr", lambda x, y: F.log(x / y).cast("float")).alias("ratio"))
        every = ruled.sparkSession.range(0, N**order, 1, 1).select(F.col("id").alias("context")).join(ratio, "context", "left")
        one = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("context", "ratio"))), lambda x: x["ratio"]).alias(f"m{order}"))
        row = row.join(F.broadcast(one.withColumn("k", F.lit(0))), "k")
    return materialize(row, "url-model")


def _smoothed(n: str, prior: Column, strength: float) -> Column:
    """Counts with ``strength`` more spread as the shorter context's estimate."""
    total = F.aggregate(n, F.lit(0.0), lambda s, x: s + x)
    return let(total, lambda t: F.zip_with(n, prior, lambda x, q: (x + strength * q) / (t + strength)))


def likelihood_ratio(model: DataFrame, urls: DataFrame, url: str = "url", into: str = "ratio") -> DataFrame:
    """Adds double ``into``: mean log-ratio a character, 0 for an empty or null URL. All rows stay."""
    joined = beside(urls, model.select(*[F.col(f"m{i}").alias(f"__m{i}") for i in range(ORDER + 1)]))
    start = F.struct(F.lit(N - 1).alias("x"), F.lit(N - 1).alias("y"), F.lit(N - 1).alias("z"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        found = F.coalesce(F.get(F.get(F.col("__m3"), (s["x"] * N + s["y"]) * N + s["z"]), c), F.get(F.get(F.col("__m2"), s["y"] * N + s["z"]), c), F.get(F.get(F.col("__m1"), s["z"]), c), F.get(F.get(F.col("__m0"), F.lit(0)), c), F.lit(0.0).cast("float"))
        return F.struct(s["y"].alias("x"), s["z"].alias("y"), c.alias("z"), (s["sum"] + found.cast("double")).alias("sum"))

    score = let(symbols_of(F.col(url)), lambda s: F.aggregate(s, start, step)["sum"] / F.greatest(F.size(s), F.lit(1)))
    return joined.withColumn(into, score).drop(*[f"__m{i}" for i in range(ORDER + 1)])


def calibrate(scored: DataFrame, score: str = "ratio", bins: int = 400, span: float = 4.0) -> DataFrame:
    """One row (threshold): the score from which accepting is most often right, both kinds weighing the same.

    ``scored`` holds the score and ``accepted``. Counts in ``bins`` equal steps
    of [-span, span] stand for the scores, so that ``bins`` rows are sorted,
    whatever the input's size. Among equally good thresholds the one closest to
    0 is taken; without rows of both kinds it is 0.
    """
    step = 2 * span / bins
    at = F.least(F.greatest(F.floor((F.col(score) + span) / step), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy(at.alias("bin")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    every = scored.sparkSession.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("bin", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("r", F.lit(0)).alias("r")))).alias("h"))
    total = listed.select("h", F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x["a"]).alias("na"), F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x["r"]).alias("nr"))
    # Accepting from bin b on: rejected below b are right, accepted from b on are right.
    first = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"), F.lit(-1.0).alias("best"), F.lit(0.0).alias("at"))

    def walk(s: Column, x: Column) -> Column:
        right = (F.col("na") - s["a"]) / F.col("na") + s["r"] / F.col("nr")
        edge = x["bin"] * F.lit(step) - F.lit(span)
        better = (right > s["best"] + 1e-12) | ((F.abs(right - s["best"]) <= 1e-12) & (F.abs(edge) < F.abs(s["at"])))
        return F.struct((s["a"] + x["a"]).alias("a"), (s["r"] + x["r"]).alias("r"), F.when(better, right).otherwise(s["best"]).alias("best"), F.when(better, edge).otherwise(s["at"]).alias("at"))

    return total.select(F.when((F.col("na") > 0) & (F.col("nr") > 0), F.aggregate("h", first, walk)["at"]).otherwise(0.0).alias("threshold"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict, ratio and threshold to every row.

    ``rules`` are (``allow`` or ``block``, ``host/path``); the longest that fits
    decides, else the models do. Two thirds of the ruled URLs, by a hash of the
    URL, train the models, the others calibrate the threshold. Null URLs and
    those without ``://`` have an empty host and path and fit no rule; a null or
    empty one has ratio 0. Repeated rows are judged alike. Columns of these
    names are replaced.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.withColumns({"host": host, "path": path}).withColumn("__rule", longest_rule(rules, F.col("host"), F.col("path")))
    ruled = judged.where("__rule is not null").select(F.col(url).alias("url"), (F.col("__rule.verdict") == "allow").alias("accepted"), (F.crc32(F.col(url)) % 3 == 2).alias("held"))
    with cleared(pages.sparkSession) as stays:
        model = stays(train_url_models(ruled.where("not held")))
    threshold = materialize(calibrate(likelihood_ratio(model, ruled.where("held"))), "url-threshold")
    scored = beside(likelihood_ratio(model, judged, url).drop("threshold"), threshold)
    verdict = F.coalesce("__rule.verdict", F.when(F.col("ratio") >= F.col("threshold"), "allow").otherwise("block"))
    return scored.withColumns({"rule": F.col("__rule.rule"), "verdict": verdict}).drop("__rule")


def filter_sql(rules: list[tuple[str, str]], least: int = 4, strength: float = 4.0, bins: int = 400, span: float = 4.0) -> str:
    """DuckDB statement for :func:`filter_urls` of ``pages``: page_id, host, path, rule, verdict, ratio (6 digits)."""
    lower = f"translate({{0}}, '{UPPER}', '{LOWER}')"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(url)), lambda k: ('0x' || substr(hex(encode(url)), 2 * k + 1, 2))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295)"
    cases = []
    for verdict, rule in sorted(rules, key=lambda x: -len(x[1])):
        name, slash, rest = rule.partition("/")
        cases.append((f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash + rest}') then", rule, verdict))
    parts = [
        f"h as (select page_id, url, {lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages)",
        f"j as (select *, case {' '.join(f"{c} '{r}'" for c, r, _ in cases)} end as rule, case {' '.join(f"{c} '{v}'" for c, _, v in cases)} end as told, row_number() over () as id from h)",
        f"y as (select id, list_transform(list_filter(string_split({lower.format("regexp_replace(coalesce(url, ''), '(?s)^[^/?#]*?://', '')")}, ''), lambda c: c <> ''), lambda c: case when instr('{SYMBOLS}', c) = 0 then {N - 1} else instr('{SYMBOLS}', c) - 1 end) as s from j)",
        f"z as (select id, [{N - 1}, {N - 1}, {N - 1}] || s as s, len(s) as n from y)",
        f"g as (select id, k - 3 as i, n, ((s[k - 3] * {N} + s[k - 2]) * {N} + s[k - 1]) * {N} + s[k] as gram from (select id, n, s, unnest(range(4, n + 4)) as k from z))",
        f"u as (select id, told = 'allow' as accepted, {crc} % 3 = 2 as held from j where rule is not null)",
        "n as (select gram, count(*) filter (accepted) as a, count(*) filter (not accepted) as r from g join u using (id) where not held group by gram)",
    ]
    for k in range(ORDER + 1):
        own = f"select (gram % {N ** (k + 1)}) // {N} as context, gram % {N} as c, sum(a) as a, sum(r) as r from n group by all"
        parts += [f"n{k} as ({own})", f"t{k} as (select context, sum(a) as ta, sum(r) as tr from n{k} group by context)"]
        base = f"1.0 / {N}, 1.0 / {N}" if k == 0 else "q.pa, q.pr"
        qa, qr = base.split(", ")
        parent = "" if k == 0 else f"join p{k - 1} q on q.context = t.context % {N ** (k - 1)} and q.c = e.c"
        parts.append(f"p{k} as (select t.context, e.c, ta + tr as met, (coalesce(x.a, 0) + {strength} * {qa}) / (ta + {strength}) as pa, (coalesce(x.r, 0) + {strength} * {qr}) / (tr + {strength}) as pr from t{k} t cross join (select unnest(range({N})) as c) e left join n{k} x on x.context = t.context and x.c = e.c {parent})")
        parts.append(f"l{k} as (select context, c, ln(pa / pr)::float::double as ratio from p{k} where met >= {0 if k == 0 else least})")
    joins = " ".join(f"left join l{k} on l{k}.context = (g.gram % {N ** (k + 1)}) // {N} and l{k}.c = g.gram % {N}" for k in range(ORDER + 1))
    step = 2 * span / bins
    parts += [
        f"o as (select id, sum(coalesce({', '.join(f'l{k}.ratio' for k in range(ORDER, -1, -1))}, 0)) / max(n) as ratio from g {joins} group by id)",
        "w as (select j.*, coalesce(o.ratio, 0) as ratio from j left join o using (id))",
        f"b as (select least(greatest(floor((ratio + {span}) / {step}), 0), {bins - 1})::int as bin, count(*) filter (accepted) as a, count(*) filter (not accepted) as r from w join u using (id) where held group by bin)",
        "s as (select k as bin, coalesce(b.a, 0) as a, coalesce(b.r, 0) as r from range(400) as e(k) left join b on b.bin = k)".replace("400", str(bins)),
        f"c as (select bin * {step} - {span} as edge, (sum(a) over () - coalesce(sum(a) over (order by bin rows between unbounded preceding and 1 preceding), 0)) / nullif(sum(a) over (), 0) + coalesce(sum(r) over (order by bin rows between unbounded preceding and 1 preceding), 0) / nullif(sum(r) over (), 0) as good from s)",
        "d as (select coalesce((select edge from c where good >= (select max(good) from c) - 1e-12 order by abs(edge), edge limit 1), 0.0) as threshold)",
    ]
    return f"with {', '.join(parts)} select page_id, host, path, rule, coalesce(told, case when ratio >= threshold then 'allow' else 'block' end) as verdict, round(ratio, 6) as ratio from w, d"
