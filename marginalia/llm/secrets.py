"""Secret scans: fixed patterns, and a Markov test of what looks random.

Native: pattern matches are found as tiles of the text, so their places are sums of
lengths; a candidate's log-likelihood ratio is a fold over its characters. No shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.arrays import running
from marginalia.llm.common import fresh, let

#: The base kinds in their order, pattern, least length of the part that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters that a random string is looked for in; any other ends a candidate.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A stretch of a run has ended when its sum is this much below its best.
DROP = 10.0
#: Everyday words that ordinary identifiers are made of (samples for training only).
ORDINARY = (
    "account active address amount article average background balance before begin between border buffer cache calendar callback "
    "category channel children client column command comment commit common config content context control counter country create "
    "current customer default delete detail device dialog direction document driver element enabled entry error event example export "
    "field filter folder format frame function general group handler header height history import index input install instance item "
    "label language layout length library license listener local location manager margin market maximum message method minimum model "
    "module monitor network notice number object offset option order output package parent partner password people pixel point policy "
    "position prefix preview previous product profile project property protocol provider public quality query random reader record "
    "region release remote report request reset resource response result return review sample schedule schema screen search section "
    "select sender server service session setting shared simple source standard start status storage stream string student style "
    "subject support switch system table target template thread ticket title toggle total tracker traffic transfer update upload user "
    "value version video view visible warning window worker wrapper zone aber auch beispiel datei einstellung fehler gesellschaft "
    "nachricht schritt verbindung zeichen aujourd bonjour chemin demande fichier langue nouveau quelque utilisateur archivo ciudad "
    "cuenta ejemplo empresa mensaje nombre palabra usuario"
).split()


def labelled_samples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """``text, random``: ``rows`` strings of either kind, made by rule from hashes, so always the same.

    Random ones are base64, hex and mixed strings of 20 to 44 characters, a fifth of them
    of letters only; ordinary ones join 2 to 5 everyday words as snake, kebab, camel or
    path, some with a number, and a fifth are long words or one character repeated.
    """
    i = F.col("i")
    pick = lambda k: F.get(F.split(F.lit(" ".join(ORDINARY)), " "), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(ORDINARY))).cast("int"))
    digest = F.sha2(F.concat(F.lit("r"), i.cast("string")), 256)
    cut_to = lambda s: F.substr(s, F.lit(1), (F.pmod(F.xxhash64(i, F.lit(99)), F.lit(25)) + 20).cast("int"))
    coded = F.base64(F.unhex(digest))
    by = lambda k, n: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(n))
    random = cut_to(F.when(by(50, 8) == 0, digest).when(by(50, 8) == 1, F.upper(F.translate(coded, "+/=", "XQ"))).when(by(50, 8) < 5, F.translate(coded, "+/=", "xQ")).otherwise(coded))
    letters = cut_to(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("l"), i.cast("string")), 512))), "[^A-Za-z]", ""))
    random = F.when(by(56, 5) > 0, random).when(by(57, 6) == 0, F.lower(letters)).when(by(57, 6) == 1, F.upper(letters)).otherwise(letters)
    words = F.slice(F.array(*[pick(k) for k in range(5)]), 1, (by(51, 4) + 2).cast("int"))
    camel = F.aggregate(words, F.lit(""), lambda acc, w: F.concat(acc, F.initcap(w)))
    plain = F.when(by(52, 4) == 0, F.array_join(words, "_")).when(by(52, 4) == 1, F.array_join(words, "-")).when(by(52, 4) == 2, camel).otherwise(F.array_join(words, "/"))
    plain = F.when(by(53, 3) == 0, F.concat(plain, by(54, 1000).cast("string"))).otherwise(plain)
    same = cut_to(F.repeat(F.substr(F.lit(ALPHABET), (by(60, len(ALPHABET)) + 1).cast("int"), F.lit(1)), F.lit(44)))
    plain = F.when(by(58, 5) > 0, plain).when(by(59, 4) == 0, same).otherwise(F.array_join(words, ""))
    plain = F.when(by(55, 10) == 0, F.upper(plain)).otherwise(plain)
    ids = spark.range(rows).select(F.col("id").alias("i"))
    return ids.select(random.alias("text"), F.lit(True).alias("random")).union(ids.select(plain, F.lit(False)))


def train_markov(samples: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row of (1 + the alphabet)²; 0 is any other character.

    Pairs are counted by group in the cluster; what comes to the driver is bounded by
    the square of the alphabet. No samples: all ratios are 0.
    """
    n = len(ALPHABET) + 1
    index = lambda c: F.instr(F.lit(ALPHABET), c)
    chars = samples.where("text is not null").select("random", F.filter(F.split("text", ""), lambda c: c != "").alias("c"))
    pairs = chars.select("random", F.explode(F.transform(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), lambda c, i: F.struct(index(c).alias("x"), index(F.get("c", i + 1)).alias("y")))).alias("p"))
    counts = {(r[0], r[1], r[2]): r[3] for r in pairs.groupBy("random", "p.x", "p.y").count().collect()}
    after = {(k, x): sum(counts.get((k, x, y), 0) for y in range(n)) for k in (True, False) for x in range(n)}
    p = lambda k, x, y: (counts.get((k, x, y), 0) + alpha) / (after[k, x] + alpha * n)
    return [math.log(p(True, x, y) / p(False, x, y)) for x in range(n) for y in range(n)]


def _spans(text: Column, pattern: str, hint: Column, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, k, e>>.

    The text is tiled by (what lies before, match): no match starts before the one that
    ended, and ``\\G`` keeps the rest after the last match from being tried again.
    """
    tile = rf"\G((?s:.*?))({pattern})"

    def place(tiles: Column) -> Column:
        size = lambda a: F.transform(a, lambda x: F.length(x))
        matches, values = F.regexp_extract_all(text, F.lit(tile), 2), F.regexp_extract_all(text, F.lit(tile), 2 + value_group)
        ends = running(size(tiles), lambda x, y: x + y)
        item = F.arrays_zip(ends.alias("e"), size(matches).alias("m"), size(values).alias("v"))
        return F.transform(F.filter(item, lambda x: x["v"] >= least), lambda x: F.struct((x["e"] - x["m"]).alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))

    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return F.when(hint, let(F.regexp_extract_all(text, F.lit(tile), 0), place)).otherwise(none)


def _stretches(scores: Column, least: int) -> Column:
    """``s, e`` of the stretches of ``least`` or more characters with the greatest sums above 0, from left to right.

    ``scores`` are those of a run's character pairs, less the threshold. The sum before
    the stretch is the least so far, ``least - 1`` pairs or more behind; a stretch ends
    where its sum was greatest once it has lost DROP since, and the next begins there.
    """
    items = F.transform(scores, lambda x, i: F.struct(x.alias("d"), F.coalesce(F.get(scores, i - (least - 1)), F.lit(0.0)).alias("behind"), (i + 1).alias("b")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(
        F.lit(0.0).alias("p"), F.lit(0.0).alias("lag"), F.lit(float("inf")).alias("low"), F.lit(0).alias("at"), F.lit(0.0).alias("gain"),
        F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0.0).alias("top"), F.lit(0).alias("base"), none.alias("out"),
    )
    put_out = lambda acc: F.when(acc["e"] > 0, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), (acc["e"] + 1).alias("e"))))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        a = x["b"] - (least - 1)
        moved = F.struct((acc["p"] + x["d"]).alias("p"), (acc["lag"] + x["behind"]).alias("lag"))

        def lower(n: Column) -> Column:
            is_low = (a >= acc["base"]) & (n["lag"] < acc["low"])
            return let(F.struct(F.when(is_low, n["lag"]).otherwise(acc["low"]).alias("low"), F.when(is_low, a).otherwise(acc["at"]).alias("at")), lambda m: done(n, m))

        def done(n: Column, m: Column) -> Column:
            keep = [acc[c].alias(c) for c in ("base", "out")]
            better = F.struct(n["p"].alias("p"), n["lag"].alias("lag"), m["low"].alias("low"), m["at"].alias("at"), (n["p"] - m["low"]).alias("gain"), m["at"].alias("s"), x["b"].alias("e"), n["p"].alias("top"), *keep)
            over = F.struct(
                n["p"].alias("p"), n["lag"].alias("lag"), F.lit(float("inf")).alias("low"), F.lit(0).alias("at"), F.lit(0.0).alias("gain"),
                F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0.0).alias("top"), x["b"].alias("base"), put_out(acc).alias("out"),
            )
            same = F.struct(n["p"].alias("p"), n["lag"].alias("lag"), m["low"].alias("low"), m["at"].alias("at"), *[acc[c].alias(c) for c in ("gain", "s", "e", "top")], *keep)
            return F.when(n["p"] - m["low"] > acc["gain"], better).when((acc["e"] > 0) & (n["p"] < acc["top"] - DROP), over).otherwise(same)

        return let(moved, lower)

    return F.aggregate(items, start, step, put_out)


def _merged(spans: Column) -> Column:
    """Overlapping or touching ``s, e`` as one, from left to right: one begins where no span before reaches, and ends where the next begins at last."""

    def of(reach: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(reach) - 1), lambda i: (i == 0) | (F.get(spans, i)["s"] > F.get(reach, i - 1)))
        end = lambda at, j: F.get(reach, F.coalesce(F.get(at, j + 1), F.size(reach)) - 1)
        return let(opens, lambda at: F.transform(at, lambda i, j: F.struct(F.get(spans, i)["s"].alias("s"), end(at, j).alias("e"))))

    ends = running(F.transform(spans, lambda x: x["e"]), lambda x, y: F.greatest(x, y))
    return F.when(F.size(spans) > 0, let(ends, of)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _apart(spans: Column, others: Column, some: int = 256) -> Column:
    """The ``spans`` (sorted, disjoint) that overlap none of ``others``; some at a time are held against what overlaps any of them."""
    overlap = lambda s, e: lambda y: (y["s"] < e) & (s < y["e"])

    def of(part: Column) -> Column:
        near = F.filter(others, overlap(F.element_at(part, 1)["s"], F.element_at(part, -1)["e"]))
        return let(near, lambda n: F.filter(part, lambda x: ~F.exists(n, overlap(x["s"], x["e"]))))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / some).cast("int")), lambda i: F.slice(spans, i * some + 1, some))
    return F.when(F.size(spans) > 0, F.flatten(F.transform(parts, of))).otherwise(spans)


def _random_parts(run: Column, ratios: Column, least: int, threshold: float) -> Column:
    """``s, e`` of what looks random in a run: all of it if its mean log-likelihood ratio is above ``threshold``, else its stretches above it, with the rest of the words they begin and end in; each holds a letter."""
    n = len(ALPHABET) + 1
    has_letter = lambda s, e: F.substr(run, s + 1, e - s).rlike("[A-Za-z]")

    def scores(c: Column) -> Column:
        return F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.get(ratios, F.instr(F.lit(ALPHABET), x) * n + F.instr(F.lit(ALPHABET), F.get(c, i + 1))) - threshold)

    def widened(x: Column) -> Column:
        before, after = F.reverse(F.substr(run, F.lit(1), x["s"])), F.substr(run, x["e"] + 1)
        more = lambda c: F.length(F.regexp_extract(c, "^[A-Za-z0-9+]*", 0))
        return F.struct((x["s"] - more(before)).alias("s"), (x["e"] + more(after)).alias("e"))

    def parts(d: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("s"), F.length(run).alias("e")))
        return F.when(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x) > 0, whole).otherwise(_merged(F.transform(_stretches(d, least), widened)))

    found = let(let(F.filter(F.split(run, ""), lambda x: x != ""), scores), parts)
    return F.when(run.rlike("[A-Za-z]"), F.filter(found, lambda x: has_letter(x["s"], x["e"]))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def scan(docs: DataFrame, ratios: list[float], text: str = "text", into: str = "secrets", least: int = 20, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``into``: an array of struct(s, k, e), start and end in code points and index into KINDS, by s then k.

    Base kinds are matched as given above. ``markov`` spans come from runs of ``least``
    or more characters of ALPHABET that touch no base span: the whole run if it scores
    over ``threshold`` a character, else its stretches of ``least`` or more characters
    that do (a key behind a path), as far as ``/``, ``_``, ``-``, ``=`` or an end. Each
    holds a letter. Null and empty texts have none; all texts are scanned whole.
    Repeated rows get equal spans; an empty table stays empty. A column named ``into``
    is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    run = rf"[A-Za-z0-9+/_=-]{{{least},}}"
    base = F.concat(
        _spans(t, ASSIGN, t.rlike(ASSIGN_HINT), "assign", 1, 8), _spans(t, ACCESS, F.contains(t, F.lit("AKIA")), "access"), _spans(t, HEX, t.rlike(HEX), "hex")
    )
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    b, c = fresh(docs, "_base"), fresh(docs, "_runs")
    made = docs.withColumn(b, base).withColumn(c, _spans(t, run, t.rlike(run), "markov"))

    def random(spans: Column) -> Column:
        found = lambda x: _random_parts(F.substr(t, x["s"] + 1, x["e"] - x["s"]), table, least, threshold)
        place = lambda x: lambda y: F.struct((x["s"] + y["s"]).alias("s"), x["k"].alias("k"), (x["s"] + y["e"]).alias("e"))
        return F.flatten(F.transform(_apart(spans, F.col(b)), lambda x: F.transform(found(x), place(x))))

    return made.withColumn(into, F.sort_array(F.concat(F.col(b), F.when(F.size(c) > 0, random(F.col(c))).otherwise(F.col(c))))).drop(b, c)


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    name = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark`` (overlapping or touching spans by one), columns as they were.

    Texts without secrets stay as they are, null and empty ones too; repeated rows are
    all changed alike; an empty table stays empty.
    """
    found = fresh(docs, "_secrets")
    made = scan(docs, ratios, text, found)

    def rebuilt(spans: Column) -> Column:
        def of_chars(chars: Column) -> Column:
            begin = lambda i: F.coalesce(F.get(spans, i - 1)["e"], F.lit(0))
            part = lambda i: F.array_join(F.slice(chars, begin(i) + 1, F.coalesce(F.get(spans, i)["s"], F.size(chars)) - begin(i)), "")
            return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), part), mark)

        return let(F.split(F.col(text), ""), of_chars)

    new = F.when(F.size(found) > 0, let(_merged(F.col(found)), rebuilt)).otherwise(F.col(text))
    return made.withColumn(text, new).select(*docs.columns)
