"""Personal data by boosting over candidate spans; DataFrame operations only.

Generators (regular expressions of high recall, some overlapping) propose spans of four kinds. Spans of the base
generators that pass their format's check always count. All other candidates, also base matches that fail, are described by format and
context features and scored by boosted trees, which are plain SQL expressions when they run; a candidate is added when
its score reaches its kind's threshold and it overlaps no span that counts already. Trees and thresholds are fitted on
the driver from a fixed number of made-up sentences with known labels (TRAIN_ROWS), run through the same generators and
features; half of them set the trees, the other half each kind's threshold, at which at most 2 % of the redactions are
wrong.

Places come without Python: a text split by a pattern and the pattern's matches have lengths whose running sums, by
document and generator, are the starts. Only documents with a digit or an "@" or "at" in brackets get that far."""

from __future__ import annotations

import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.llm.common import per_row

KINDS = ("email", "ip", "card", "phone")
#: Generator: kind and pattern; the first of a kind is its base. Possessive forms and the look-behinds give the same
#: matches as the plain ones, without backtracking over long runs.
GENERATORS = {
    "email": ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "email_at": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"),
    "phone_loose": ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
    "phone_local": ("phone", r"(?<![0-9+./-])0[0-9]{1,4}[\x20/-][0-9]{2,4}(?:[\x20-][0-9]{2,4}){1,3}(?![0-9])"),
    "ip_loose": ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20?[\[(](?:\.|dot)[\])]\x20?|\x20\.\x20)[0-9]{1,3}){3}(?![0-9.])"),
    "card_loose": ("card", r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"),
}
TRIGGER = r"[0-9]|@|[\[(]at[\])]"
CONTEXT = 24
TRAIN_ROWS, TREES, DEPTH, RATE = 3_000, 40, 2, 0.3
HINTS = {
    "email": r"(?i)mail|contact|write|schreib|écri|correo",
    "ip": r"(?i)\bip\b|address|server|host|adresse",
    "card": r"(?i)card|visa|pay|karte|carte|tarjeta",
    "phone": r"(?i)call|phone|tel|fax|mobile|ring|ruf|llam",
}
AGAINST = r"(?i)order|invoice|ref|id|serial|version|page|no\.|isbn|sku|bestell|commande"


def _luhn(digits: Column) -> Column:
    """Whether the digits' check sum holds."""
    own = F.split(F.reverse(digits), "")
    value = F.transform(own, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda s, x: s + x) % 10 == 0


def _base_valid(generator: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    part = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip = F.forall(part, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(999)) <= 255))
    card = n.between(14, 19) & F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    return F.when(generator == "email", True).when(generator == "ip", ip).when(generator == "card", card).when(generator == "phone", n.between(10, 15)).otherwise(False)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, generator, kind, start, end, base, match and its surroundings, for texts (not null) of unique doc_id."""
    rows = docs.where(F.col("text").rlike(TRIGGER))
    found = []
    for name, (kind, pattern) in GENERATORS.items():
        quick = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "email_at": F.col("text").rlike(r"[\[(]at[\])]")}.get(name)
        matches, pieces = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
        if quick is not None:
            matches, pieces = F.when(quick, matches).otherwise(F.array().cast("array<string>")), F.when(quick, pieces).otherwise(F.array().cast("array<string>"))
        found.append((name, kind, matches, pieces))
    parts = rows.select("doc_id", *(c.alias(f"{k}_{name}") for name, _, m, p in found for k, c in (("m", m), ("p", p))))
    spans = F.concat(*(_spans(name, kind) for name, kind, _, _ in found))
    out = parts.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")
    order = Window.partitionBy("doc_id", "generator").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    out = out.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    return out.withColumn("base", _base_valid(F.col("generator"), F.col("match"))).drop("i", "gap")


def _spans(name: str, kind: str) -> Column:
    pieces = F.col(f"p_{name}")

    def one(m: Column, i: Column) -> Column:
        before, after = F.get(pieces, i), F.get(pieces, i + 1)
        return F.struct(F.lit(name).alias("generator"), F.lit(kind).alias("kind"), i.alias("i"), F.length(before).alias("gap"), m.alias("match"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))

    return F.transform(f"m_{name}", one)


def features(rows: DataFrame) -> DataFrame:
    """With columns f0, f1, ... of small numbers."""
    m, digits = F.col("match"), F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    hint = F.coalesce(*(F.when(F.col("kind") == k, F.col("before").rlike(p)) for k, p in HINTS.items()))
    own = [
        *((F.col("kind") == k).cast("int") for k in KINDS),
        n,
        F.length(m) - n,
        hint.cast("int"),
        F.col("before").rlike(AGAINST).cast("int"),
        F.col("before").rlike(r"[\p{L}\p{N}_#=/]$").cast("int"),
        F.col("after").rlike(r"^[\p{L}\p{N}_=/]").cast("int"),
        F.regexp_count(m, F.lit(r"[\x20.()/_-]")),
        F.when(n.between(12, 19), _luhn(digits)).otherwise(False).cast("int"),
        m.rlike(r"\(").cast("int"),
        m.rlike(r"^[0-9]{4}([ ./_-]?[0-9]{4}){3}$").cast("int"),
        m.rlike(r"(?i)at").cast("int"),
        F.forall(F.split(m, "[^0-9]+"), lambda x: (F.length(x) <= 3) & (F.coalesce(F.substring(x, 1, 3).try_cast("int"), F.lit(0)) <= 255)).cast("int"),
    ]
    return rows.withColumns({f"f{i}": c for i, c in enumerate(own)})


N_FEATURES = 16


def _made_up() -> list[tuple[int, str, str]]:
    """Sentences with one thing of interest each, and the kind of personal data that it is (else the empty string)."""
    rng = random.Random(11)
    out = []
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(ok: bool) -> str:
        head = number(15)
        total = sum(int(d) if i % 2 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(head))
        return head + str((-total + (0 if ok else rng.randrange(1, 9))) % 10)

    for i in range(TRAIN_ROWS):
        good = rng.random() < 0.5
        shape = rng.randrange(7)
        if shape == 0:
            thing = f"{word()}.{word()}{rng.choice([' [at] ', '[at]', ' (at) '])}{word()}{rng.choice(['.', ' [dot] '])}{rng.choice(['com', 'org', 'net'])}"
            lead = rng.choice(["mail me: ", "contact ", "write to ", word() + " "]) if good else rng.choice(["version ", "ref ", "id="])
        elif shape == 1:
            thing = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(number(3), number(3), number(4))
            lead = rng.choice(["call ", "phone: ", "tel. ", "mobile "]) if good else rng.choice(["order ", "invoice ", "serial no. ", "ref ", word() + " ", "page "])
        elif shape == 2:
            raw = card(good)
            thing = rng.choice(["/", ".", "_"]).join(raw[k : k + 4] for k in range(0, 16, 4))
            lead = rng.choice(["card ", "visa ", "pay with "]) if good else rng.choice(["order ", "serial ", word() + " ", "id "])
        elif shape == 3:
            thing = ".".join(number(3) for _ in range(4)) if not good else f"+{number(9)}"
            lead = rng.choice(["call ", "phone "]) if good else rng.choice(["version ", word() + " ", "page "])
        elif shape == 5:
            thing = rng.choice(["[.]", "(.)", " . ", "[dot]", " [dot] "]).join(str(rng.randrange(256) if good else rng.choice([rng.randrange(256), rng.randrange(256, 1000)])) for _ in range(4))
            lead = rng.choice(["ip ", "server ", "host ", "address ", word() + " "]) if good else rng.choice(["version ", "page ", "ref ", "section "])
        elif shape == 6:
            thing = "0" + number(rng.randrange(1, 4)) + rng.choice([" ", "/", "-"]) + rng.choice([" ", "-"]).join(number(rng.randrange(2, 5)) for _ in range(rng.randrange(2, 4)))
            lead = rng.choice(["call ", "phone: ", "tel. ", "ruf ", "fax "]) if good else rng.choice(["order ", "invoice ", "serial no. ", "ref ", word() + " ", "page "])
        else:
            good = False
            thing = rng.choice([f"20{number(2)}-{number(2)}-{number(2)}", number(rng.randrange(1, 12)), f"{number(2)}:{number(2)}", f"{number(1)},{number(3)},{number(3)}", f"{number(3)}-{number(4)}", number(16)])
            lead = rng.choice([word() + " ", "on ", "call ", "card ", "phone "])
        out.append((i, f"{word()} {word()} {lead}{thing} {word()}", ("email", "phone", "card", "phone", "", "ip", "phone")[shape] if good else ""))
    return out


def _boost(rows: list[tuple[list[float], int]]) -> list[tuple]:
    """Trees of depth two over (feature, cut): squared-error fits of the gradient of the log loss."""
    import numpy as np

    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    z, trees = np.zeros(len(y)), []
    cuts = [(f, c) for f in range(x.shape[1]) for c in np.unique((np.unique(x[:, f])[1:] + np.unique(x[:, f])[:-1]) / 2)[:24]]

    def split(at: np.ndarray, r: np.ndarray) -> tuple[int, float] | None:
        best, pick = 1e-9, None
        total, n = r[at].sum(), at.sum()
        for f, c in cuts:
            left = at & (x[:, f] < c)
            k = left.sum()
            if 10 <= k <= n - 10:
                s = r[left].sum()
                gain = s * s / k + (total - s) ** 2 / (n - k) - total * total / n
                if gain > best:
                    best, pick = gain, (f, c)
        return pick

    def leaf(at: np.ndarray, r: np.ndarray, p: np.ndarray) -> float:
        return float(RATE * r[at].sum() / ((p * (1 - p))[at].sum() + 1.0))

    def grow(at: np.ndarray, depth: int, r: np.ndarray, p: np.ndarray):
        pick = split(at, r) if depth else None
        if pick is None:
            v = leaf(at, r, p)
            z[at] += v
            return v
        f, c = pick
        return f, c, grow(at & (x[:, f] < c), depth - 1, r, p), grow(at & (x[:, f] >= c), depth - 1, r, p)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(np.ones(len(y), bool), DEPTH, y - p, p))
    return trees


def _value(tree, x: list[float]) -> float:
    while isinstance(tree, tuple):
        f, c, a, b = tree
        tree = a if x[f] < c else b
    return tree


def _sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, c, a, b = tree
    return f"CASE WHEN f{f} < {c!r}D THEN {_sql(a)} ELSE {_sql(b)} END"


def _plain(tree):
    return tuple(_plain(x) if isinstance(x, tuple) else (int(x) if i == 0 else float(x)) for i, x in enumerate(tree)) if isinstance(tree, tuple) else float(tree)


@lru_cache(1)
def fitted(spark: SparkSession) -> tuple[str, dict[str, float]]:
    """The trees' sum as SQL, and each kind's threshold on it."""
    made = _made_up()
    rows = features(candidates(spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string").repartition(4)))
    got = rows.where(~F.col("base")).select("doc_id", "kind", *(f"f{i}" for i in range(N_FEATURES))).collect()  # TRAIN_ROWS sentences
    data = sorted((r.doc_id, r.kind, [float(r[f"f{i}"]) for i in range(N_FEATURES)], int(made[r.doc_id][2] == r.kind)) for r in got)
    trees = [_plain(t) for t in _boost([(x, y) for i, _, x, y in data if i % 2])]
    limits = {}
    for kind in KINDS:
        own = sorted(((sum(_value(t, x) for t in trees), y) for i, k, x, y in data if not i % 2 and k == kind), reverse=True)
        wrong, limits[kind] = 0, math.inf
        for n, (s, y) in enumerate(own, 1):
            wrong += 1 - y
            if y and wrong <= 0.02 * n:
                limits[kind] = s
    return " + ".join(f"({_sql(t)})" for t in trees), limits


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of kind:start:end by start, then kind), spans (all,
    joined likewise), n_added, for every document.

    Places are code points, ends exclusive. Null and empty texts have no span. Rows with a null or repeated doc_id count as
    documents of their own (see per_row); an empty table gives an empty result; other columns are not looked at."""
    return per_row(docs, _find)


def _find(docs: DataFrame) -> DataFrame:
    trees, limits = fitted(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = features(candidates(texts)).withColumn("score", F.expr(trees))
    limit = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()))
    rows = rows.where(F.col("base") | (F.col("score") >= limit))
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)))
    rows = rows.select("doc_id", "kind", rank.alias("rank"), "start", "end", "base")
    by = Window.partitionBy("doc_id").orderBy("start", F.col("base").desc(), F.col("end").desc(), "rank")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    clash = (F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(before), F.lit(0)) > F.col("start")) | (F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after), F.col("end")) < F.col("end"))
    rows = rows.withColumn("clash", ~F.col("base") & clash).where(~F.col("clash"))
    span = F.struct("start", "rank", F.concat_ws(":", "kind", F.col("start"), F.col("end")).alias("s"))
    added = F.struct("start", (-F.col("end")).alias("back"), "rank", span.alias("span"), F.col("end").alias("end"))
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    own = rows.groupBy("doc_id").agg(*counts, F.collect_list(F.when(F.col("base"), span)).alias("base"), F.sort_array(F.collect_list(F.when(~F.col("base"), added))).alias("more"))
    # from left to right, an added span stays unless it overlaps one that stayed
    kept = F.aggregate("more", F.struct(F.lit(0).cast("int").alias("upto"), F.slice(F.transform("more", lambda x: x["span"]), 1, 0).alias("kept")), lambda s, x: F.when(x["start"] >= s["upto"], F.struct(x["end"].cast("int").alias("upto"), F.concat(s["kept"], F.array(x["span"])).alias("kept"))).otherwise(s), lambda s: s["kept"])
    own = own.withColumn("more", kept)
    names = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["s"]), ",")
    own = own.select("doc_id", *(f"n_{k}" for k in KINDS), names(F.col("base")).alias("b"), names(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_added"))
    zero, empty = F.lit(0).cast("long"), F.lit("")
    out = ids.join(own, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("b", empty), 256).alias("base_sha256"), F.coalesce("spans", empty).alias("spans"), F.coalesce("n_added", zero).alias("n_added"))
