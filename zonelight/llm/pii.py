"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall generators propose spans: the four base kinds (email, ip, card, phone), and loose ones that may
overlap (secrets after a key word, long mixed tokens, number groups, written-out addresses).  Boosted trees
score each loose candidate by format and context; a threshold for each kind, calibrated on held-out rows
for a target precision, selects what is redacted.  Base spans that pass their own checks always stay; a
selected candidate that overlaps a base span gives way, and of selected ones that overlap the likelier stays.

The trees are fitted on ``TRAIN_ROWS`` labelled snippets made from a fixed seed, whose features come from the
same column expressions as the corpus's.  Fitting and calibration take place on the driver, on those rows
alone; the fitted trees are one SQL expression.

Spans are in code points, end exclusive.  Patterns are written so that they scan in linear time and without
recursion: a run is entered at its start only (or where the match before ended) and left possessively.  Spans are
selected in passes over sorted arrays, in blocks, so a text of very many spans costs little more than its length.
Defined results: a null text counts as empty and has no span; repeated rows give repeated rows; an empty
table gives an empty result; columns whose names clash with working columns pass through ``redact``.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import documents

BASE = ["email", "ip", "card", "phone"]
LOOSE = ["secret", "token", "number", "contact"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?i:password|passwd|secret|token|api[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[^ \t\r\n\"']{4,}+",
    "token": r"\b(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+",
    "number": r"(?:(?<![0-9A-Za-z])|\G)[(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
    "contact": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)++",
}
#: What a text must hold for a pattern to match at all; cheaper to look for than the pattern.
HINTS = {"email": "_pii_text LIKE '%@%'", "ip": "_digit", "card": "_digit", "phone": "_digit AND _pii_text LIKE '%+%'", "secret": "_pii_text LIKE '%=%' OR _pii_text LIKE '%:%'", "token": "_digit", "number": "_digit", "contact": "_pii_text LIKE '%at)%' OR _pii_text LIKE '%at]%' OR _pii_text LIKE '%AT)%' OR _pii_text LIKE '%AT]%'"}
TRAIN_ROWS, ROUNDS, RATE, PRECISION = 4_000, 24, 0.4, 0.98
BLOCK = 256
FEATURES = {
    "size": "length(c.value)",
    "digits": "length(regexp_replace(c.value, '[^0-9]', ''))",
    "upper": "length(regexp_replace(c.value, '[^A-Z]', ''))",
    "lower": "length(regexp_replace(c.value, '[^a-z]', ''))",
    "kinds": "size(array_distinct(split(regexp_replace(c.value, '[^0-9A-Za-z]', ''), '')))",
    "luhn": "int(luhn_check(regexp_replace(c.value, '[^0-9]', '')))",
    "hex": "int(c.value rlike '^[0-9a-f]+$')",
    "groups": "size(split(c.value, '[^0-9A-Za-z]+'))",
    "keyed": "int(c.value rlike '^(?i:pass|secret|token|api)')",
    "valued": "length(regexp_extract(c.value, '[=:][^A-Za-z0-9]*(.*)$', 1))",
    "asked": "int(lower(c.before) rlike '(?:tel|phone|call|mobile|fax|ssn|id)[^a-z]*$')",
    "told": "int(lower(c.before) rlike '(?:key|secret|token|password|bearer)[^a-z]*$')",
    "glued": "int(c.before rlike '[A-Za-z0-9_/.,-]$' OR c.after rlike '^[A-Za-z0-9_/]')",
    "zeros": "length(regexp_replace(c.value, '[^0]', ''))",
    "written": "int(c.value rlike '(?:at|AT)[])]')",
}


def _located(matches: str, gaps: str) -> str:
    """Spans of a pattern's matches, from the matches and the text between them.

    Places are running sums; blocks keep the cost of building the array linear in practice.
    """
    kind = "array<struct<start: int, end: int, value: string, before: string, after: string>>"
    at = f"a.pos + length({gaps}[i])"
    one = f"named_struct('start', {at}, 'end', {at} + length({matches}[i]), 'value', {matches}[i], 'before', right({gaps}[i], 24), 'after', left({gaps}[i + 1], 4))"
    inner = f"aggregate(sequence(b * {BLOCK}, least(size({matches}) - 1, b * {BLOCK} + {BLOCK - 1})), named_struct('pos', o.pos, 'out', cast(array() AS {kind})), (a, i) -> named_struct('pos', {at} + length({matches}[i]), 'out', concat(a.out, array({one}))))"
    outer = f"transform(array({inner}), x -> named_struct('pos', x.pos, 'out', concat(o.out, array(x.out))))[0]"
    return f"CASE WHEN size({matches}) > 0 THEN aggregate(sequence(0, cast((size({matches}) - 1) DIV {BLOCK} AS int)), named_struct('pos', 0, 'out', cast(array() AS array<{kind}>)), (o, b) -> {outer}, r -> flatten(r.out)) ELSE cast(array() AS {kind}) END"


CHECKS = {
    "email": "true",
    "ip": "forall(split(c.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": "length(regexp_replace(c.value, '[ -]', '')) BETWEEN 16 AND 19 AND luhn_check(regexp_replace(c.value, '[ -]', ''))",
    "phone": "length(regexp_replace(c.value, '[^0-9]', '')) BETWEEN 8 AND 15",
}


def _matched(df: DataFrame, text: Column, kinds: list[str]) -> DataFrame:
    """df with _<kind>: array of located matches of each pattern."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_pii_text", F.coalesce(text.cast("string"), F.lit("")))
    df = df.withColumn("_digit", F.col("_pii_text").rlike("[0-9]"))
    df = df.withColumns({f"_m_{k}": F.when(F.expr(HINTS[k]), F.regexp_extract_all("_pii_text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in kinds})
    df = df.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_pii_text", PATTERNS[k], -1)) for k in kinds})
    df = df.withColumns({f"_{k}": F.expr(_located(f"_m_{k}", f"_g_{k}")) for k in kinds})
    return df.drop("_pii_text", "_digit", *(f"_{x}_{k}" for x in "mg" for k in kinds))


def _featured(column: str) -> str:
    return f"transform({column}, c -> named_struct('start', c.start, 'end', c.end, {', '.join(f'{chr(39)}{n}{chr(39)}, {e}' for n, e in FEATURES.items())}))"


def training_rows(n: int = TRAIN_ROWS, seed: int = 7) -> list[tuple[int, str, int]]:
    """(kind's number, snippet, label): made-up candidates of every loose kind among made-up words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "an", "re", "ou", "le", "ti", "en", "qu", "es", "der"]) for _ in range(r.randint(1, 4)))
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    digits, hexes = string.digits, "0123456789abcdef"
    out = []
    for _ in range(n):
        k, yes = r.randrange(4), r.random() < 0.5
        lead, tail = " ".join(word() for _ in range(3)), " " + word() + "."
        if k == 0:
            name = r.choice(["password", "Password", "token", "secret", "api_key", "PASSWORD", "SECRET", "API_KEY"])
            value = pick(hexes, r.choice([18, 16, 32, 40])) if r.random() < 0.6 else pick(string.ascii_letters + digits + "!#%", r.randint(8, 24))
            name, quoted = (f'"{name}"', True) if r.random() < 0.25 else (name, False)  # a key of JSON
            body = f"{name}{r.choice([': ', ':'] if quoted else ['=', ' = ', ': ', '='])}{chr(34) if quoted else r.choice(['', chr(34)])}{value}" if yes else f"{name}{': ' + chr(34) if quoted else r.choice([': ', ' = ', '='])}{r.choice([word() + word(), 'none', 'true', 'null', 'required', word() + 'ing'])}"
        elif k == 1:
            if yes:
                body = r.choice([lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16), lambda: pick(hexes, r.choice([32, 40, 64])), lambda: pick(string.ascii_letters + digits, r.randint(24, 48)), lambda: "sk_" + pick(string.ascii_letters + digits, 24)])()
                lead += r.choice(["", "", " key", " token"])
            else:
                body = r.choice([lambda: "".join(word() for _ in range(8))[: r.randint(16, 30)].ljust(16, "e"), lambda: "".join(word() for _ in range(8)).title()[:24].ljust(16, "e"), lambda: ("".join(word() for _ in range(6)) + "_" + word())[:40].ljust(17, "a"), lambda: ("".join(word() for _ in range(8)) + str(r.randint(1, 2030)))[-26:].rjust(16, "t"), lambda: "".join(word() for _ in range(9)).upper()[:28].ljust(16, "E")])()
        elif k == 2:
            if yes:
                body = r.choice([lambda: f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", lambda: f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", lambda: f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}", lambda: f"0{pick(digits, 2)} {pick(digits, 4)} {pick(digits, 4)}"])()
                lead += r.choice(["", " call", " phone:", " tel", " ssn"])
            else:
                body = r.choice([lambda: f"{r.randint(1, 9)}.{pick(digits, 7)}", lambda: pick(digits, r.randint(7, 15)), lambda: f"{r.randint(1900, 2030)} {r.randint(1900, 2030)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 9)} {pick(digits, 3)} {pick(digits, 3)} {pick(digits, 3)}", lambda: "4" + pick(digits, 15)])()
        else:
            body = f"{word()}{r.choice(['.', ''])}{word()}{r.choice([' ', ''])}{r.choice('[(')}at{r.choice('])')} {word()}{r.choice(['.', ' (dot) ', '[dot]'])}{r.choice(['com', 'org', 'net', 'de'])}" if yes else f"{word()} (at) {word()}.{word().title()}{r.choice(['', ' (at) ' + word()])}"
        out.append((k, f"{lead} {body}{tail}", int(yes)))
    return out


class Boosted:
    """Gradient-boosted trees of depth two on logistic loss, with a calibrated threshold for each kind."""

    def __init__(self, x: np.ndarray, kind: np.ndarray, y: np.ndarray, names: list[str]) -> None:
        self.names = names
        held = np.arange(len(y)) % 4 == 0
        xt, yt = x[~held], y[~held]
        self.base = float(np.log((yt.sum() + 1) / ((1 - yt).sum() + 1)))
        self.trees: list[tuple] = []
        cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0.02, 0.98, 17), method="nearest")) for f in range(x.shape[1])]
        score = np.full(len(yt), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = yt - p, p * (1 - p) + 1e-6
            f, c = self._split(xt, g, h, cuts, np.ones(len(yt), bool))
            root = xt[:, f] <= c
            tree = (f, c, *(self._leaf_split(xt, g, h, cuts, side) for side in (root, ~root)))
            self.trees.append(tree)
            score += self._value(tree, xt)
        xh, yh, kh = x[held], y[held], kind[held]
        s = self.scores(xh)
        a, b = 1.0, 0.0  # Platt scaling by Newton steps
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((yh - p) * s).sum() - 0.01 * (a - 1), (yh - p).sum()])
            hess = np.array([[(w * s * s).sum() + 0.01, (w * s).sum()], [(w * s).sum(), w.sum()]])
            da, db = np.linalg.solve(hess, grad)
            a, b = a + da, b + db
        self.scale, self.shift = round(float(a), 6), round(float(b), 6)
        prob = 1 / (1 + np.exp(-(self.scale * s + self.shift)))
        self.thresholds = {}
        for k in range(len(LOOSE)):
            of = kh == k
            order = np.argsort(-prob[of], kind="stable")
            hits = np.cumsum(yh[of][order]) / np.arange(1, of.sum() + 1)
            good = np.flatnonzero(hits >= PRECISION)
            self.thresholds[LOOSE[k]] = round(max(0.5, float(prob[of][order][good[-1]])), 6) if len(good) else 1.1
        self.held = (kh, yh, prob)

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list, rows: np.ndarray) -> tuple[int, float]:
        best, at = -1.0, (0, float(x[:, 0].max()))
        gs, hs = g[rows].sum(), h[rows].sum()
        for f, cc in enumerate(cuts):
            v = x[rows, f]
            for c in cc:
                low = v <= c
                gl, hl = g[rows][low].sum(), h[rows][low].sum()
                gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1)
                if gain > best + 1e-12 and low.any() and not low.all():
                    best, at = gain, (f, float(c))
        return at

    def _leaf_split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list, rows: np.ndarray) -> tuple:
        f, c = self._split(x, g, h, cuts, rows)
        low = rows & (x[:, f] <= c)
        high = rows & ~low
        return (f, c, *(round(float(RATE * g[s].sum() / (h[s].sum() + 1)), 6) for s in (low, high)))

    @staticmethod
    def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
        f, c, (lf, lc, a, b), (rf, rc, d, e) = tree
        return np.where(x[:, f] <= c, np.where(x[:, lf] <= lc, a, b), np.where(x[:, rf] <= rc, d, e))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._value(t, x) for t in self.trees)

    def sql(self) -> str:
        """Calibrated probability of a candidate c, as an SQL expression on its features."""
        leaf = lambda t: f"IF(c.{self.names[t[0]]} <= {t[1]:g}, {t[2]}D, {t[3]}D)"
        trees = " + ".join(f"IF(c.{self.names[f]} <= {c:g}, {leaf(low)}, {leaf(high)})" for f, c, low, high in self.trees)
        return f"1 / (1 + exp(-({self.scale}D * ({round(self.base, 6)}D + {trees}) + {self.shift}D)))"


def fit(spark: SparkSession, n: int = TRAIN_ROWS) -> Boosted:
    """Fit and calibrate on labelled snippets; a snippet's candidate is the longest match of its kind's pattern."""
    rows = json.dumps([{"k": k, "text": t, "y": y} for k, t, y in training_rows(n)])
    made = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<k: int, text: string, y: int>>")).alias("r")).select("r.*")
    found = _matched(made, F.col("text"), LOOSE).withColumn("all", F.expr(f"CASE k {' '.join(f'WHEN {i} THEN _{k}' for i, k in enumerate(LOOSE))} END")).where("size(all) > 0")
    one = found.withColumn("longest", F.expr("array(reduce(all, all[0], (a, c) -> IF(length(c.value) > length(a.value), c, a)))"))
    got = one.select("k", "y", F.expr(_featured("longest") + "[0]").alias("f")).select("k", "y", "f.*").drop("start", "end").collect()
    names = list(FEATURES)
    x = np.array([[r[n] or 0 for n in names] for r in got], float)
    return Boosted(x, np.array([r["k"] for r in got]), np.array([r["y"] for r in got], float), names)


_SPAN = "struct<start: int, rank: int, end: int, kind: string, p: double>"


def _folded(array: str, start: str, step: str, emit: str) -> str:
    """(s, out): a pass over an array of spans c with a state s, and the spans that it emits, in order.

    Blocks keep the cost of building the array linear in practice.
    """
    none = f"cast(array() AS array<{_SPAN}>)"
    inner = f"aggregate(slice({array}, b * {BLOCK} + 1, {BLOCK}), named_struct('s', o.s, 'out', {none}), (a, c) -> transform(array(a.s), s -> named_struct('s', {step}, 'out', concat(a.out, {emit})))[0])"
    block = f"transform(array({inner}), x -> named_struct('s', x.s, 'out', concat(o.out, array(x.out))))[0]"
    return f"aggregate(sequence(0, cast((size({array}) - 1) DIV {BLOCK} AS int)), named_struct('s', {start}, 'out', cast(array() AS array<array<{_SPAN}>>)), (o, b) -> {block}, o -> named_struct('s', o.s, 'out', flatten(o.out)))"


def _selected(base: str, likely: str) -> str:
    """Of the likely candidates those that overlap no base span, and of overlapping ones the likelier.

    One pass in order of start drops what begins inside a base span, one in reverse what ends beyond the next one's
    start; in a third an overlapping candidate replaces the one before it only if it is likelier.
    """
    ranked = lambda spans, rank, kind, p: f"transform({spans}, c -> named_struct('start', c.start, 'rank', {rank}, 'end', c.end, 'kind', {kind}, 'p', {p}))"
    none = f"cast(array() AS array<{_SPAN}>)"
    merged = f"array_sort(concat({ranked(base, 0, 'c.kind', '2D')}, {ranked(likely, 1, 'c.kind', 'c.p')}))"
    forward = _folded("m", "-1", "IF(c.rank = 0, greatest(s, c.end), s)", f"IF(c.rank = 1 AND c.start < s, {none}, array(c))")
    backward = _folded("f", "2147483647", "IF(c.rank = 0, c.start, s)", f"IF(c.rank = 0 OR c.end > s, {none}, array(c))")
    sweep = _folded("k", f"cast(null AS {_SPAN})", "CASE WHEN s IS NULL OR s.end <= c.start OR c.p > s.p THEN c ELSE s END", f"IF(s.end <= c.start, array(s), {none})")
    free = f"transform(transform(array({merged}), m -> reverse({forward}.out)), f -> reverse({backward}.out))"
    return f"transform(transform({free}, k -> {sweep}), w -> IF(w.s IS NULL, w.out, concat(w.out, array(w.s))))[0]"


def find(df: DataFrame, text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """df with _base and _added (which replace columns of these names): arrays of (kind, start, end), each by kind as listed, then start."""
    model = model or fit(df.sparkSession)
    names = [c for c in df.columns if c not in ("_base", "_added")]
    out = _matched(df.select(F.struct(*df.columns).alias("row")), F.col("row").getField(text_col), BASE + LOOSE)
    checked = ", ".join(f"transform(filter(_{k}, c -> {CHECKS[k]}), c -> named_struct('kind', '{k}', 'start', c.start, 'end', c.end))" for k in BASE)
    out = out.withColumn("_base", F.expr(f"concat({checked})"))
    out = out.withColumns({f"_f_{k}": F.expr(f"CASE WHEN size(_{k}) > 0 THEN {_featured(f'_{k}')} END") for k in LOOSE})
    scored = [f"coalesce(filter(transform(_f_{k}, c -> named_struct('start', c.start, 'end', c.end, 'kind', '{k}', 'p', {model.sql()})), c -> c.p >= {model.thresholds[k]}D), array())" for k in LOOSE]
    out = out.withColumn("_likely", F.expr(f"array_sort(concat({', '.join(scored)}))"))
    out = out.withColumn("_swept", F.expr(f"CASE WHEN size(_likely) > 0 THEN {_selected('_base', '_likely')} ELSE cast(array() AS array<{_SPAN}>) END"))
    out = out.withColumn("_added", F.concat(*[F.expr(f"transform(filter(_swept, c -> c.kind = '{k}'), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))") for k in LOOSE]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "_base", "_added")


def redact(df: DataFrame, text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """df with every found span of its text replaced by its kind in angle brackets; overlapping spans count as one."""
    whole = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    out = find(whole, "t", model).withColumn("spans", F.expr("array_sort(transform(concat(_base, _added), c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind)))"))
    # blocks of spans, each over its own piece of the text
    some, part = f"slice(spans, b * {BLOCK} + 1, {BLOCK})", "cast(array() AS array<string>)"
    inner = f"aggregate({some}, named_struct('pos', o.pos, 'out', {part}), (a, c) -> IF(c.end <= a.pos, a, IF(c.start < a.pos, named_struct('pos', c.end, 'out', a.out), named_struct('pos', c.end, 'out', concat(a.out, array(substring(piece, a.pos - o.pos + 1, c.start - a.pos), concat('<', c.kind, '>')))))))"
    block = f"transform(transform(array(substring(t, o.pos + 1, array_max(transform({some}, c -> c.end)) - o.pos)), piece -> {inner}), x -> named_struct('pos', x.pos, 'out', concat(o.out, array(array_join(x.out, '')))))[0]"
    new = F.expr(f"aggregate(sequence(0, cast((size(spans) - 1) DIV {BLOCK} AS int)), named_struct('pos', 0, 'out', {part}), (o, b) -> {block}, o -> concat(array_join(o.out, ''), substring(t, o.pos + 1)))")
    return out.select(F.col("row").withField(text_col, F.when(F.size("spans") > 0, new).otherwise(F.col("row").getField(text_col))).alias("row")).select("row.*")


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(_base, c -> c.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("concat(_base, _added)").alias("spans"))


QUERIES = {"op5_personal_data": op5_personal_data}
