"""Word n-gram models: interpolated modified Kneser-Ney probabilities by aggregations and joins, ARPA files, and the scoring of texts.

An order's n-grams are never in one task: counts, totals of contexts and probabilities are grouped and joined by their words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Marks of a line's begin and end, and of words that the model doesn't know.
BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"
#: Discounts of counts 1, 2 and 3 or more where an order's counts of counts don't allow an estimate.
FALLBACK = (0.5, 1.0, 1.5)
SEPARATOR = " "
#: How many words have codes (up to four letters or digits), the codes of the marks, and what stands before words that are spelt out.
CODES, BEGIN_CODE, END_CODE, SPELT = 1 << 19, "<", ">", "~"
#: The number of the mark of begin, before all others, and the bits of a number where an n-gram's numbers fit into one of 63 bits.
BEGIN_NUMBER, BITS = 1, 20


def _names(n: int) -> list[str]:
    return [f"w{i}" for i in range(1, n + 1)]


def grams_of(lines: DataFrame, words: str, order: int, *keep: str) -> DataFrame:
    """w1 to w<order>: a row for each run of `order` words of the array column `words`, with one mark of begin and one of end."""
    marked = lines.select(*keep, F.concat(F.array(F.lit(BEGIN)), words, F.array(F.lit(END))).alias("w"))
    n = F.greatest(F.size("w") - order + 1, F.lit(0))
    shifted = F.arrays_zip(*(F.slice("w", i, n) for i in range(1, order + 1)))
    return marked.select(*keep, F.inline(shifted).alias(*_names(order)))


def codes(words: DataFrame) -> DataFrame:
    """word, code, number: short codes for the CODES most frequent values of the column `word`, the shortest for the most frequent, and for
    the marks; and the same as numbers.

    Which words have one decides how wide rows are between jobs and never what comes out, as other words are spelt out."""
    often = words.filter("word is not null").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(CODES)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "word"))  # CODES rows at any size
    marks = words.sparkSession.createDataFrame([(BEGIN, BEGIN_CODE, BEGIN_NUMBER), (END, END_CODE, BEGIN_NUMBER + 1)], "word string, code string, number long")
    numbered = often.filter(~F.col("word").isin(BEGIN, END)).select("word", place.alias("place"))
    return numbered.select("word", F.lower(F.conv(F.col("place").cast("string"), 10, 36)).alias("code"), (F.col("place") + BEGIN_NUMBER + 1).cast("long").alias("number")).unionByName(marks)


def _spelt(word: str) -> Column:
    """A word behind SPELT, without SEPARATOR."""
    return F.concat(F.lit(SPELT), F.replace(F.replace(word, F.lit("%"), F.lit("%25")), F.lit(SEPARATOR), F.lit("%20")))


def _coded(rows: DataFrame, names: list[str], book: DataFrame) -> DataFrame:
    """The words of these columns as codes; words without one are spelt out."""
    for name in names:
        found = rows.join(F.broadcast(book.select(F.col("word").alias(name), "code")), name, "left")
        rows = found.withColumn(name, F.coalesce("code", _spelt(name))).drop("code")
    return rows


def _decoded(rows: DataFrame, names: list[str], book: DataFrame) -> DataFrame:
    for name in names:
        spelt = F.replace(F.replace(F.substring(name, 2, 1 << 30), F.lit("%20"), F.lit(SEPARATOR)), F.lit("%25"), F.lit("%"))
        found = rows.join(F.broadcast(book.select(F.col("code").alias(name), "word")), name, "left")
        rows = found.withColumn(name, F.coalesce("word", F.when(_is_rare(name), spelt))).drop("word")
    return rows


def _is_rare(code: str) -> Column:
    return F.startswith(code, F.lit(SPELT))


def _part(text: str, at: int) -> Column:
    """So many words of a coded n-gram, from the left, or from the right if negative."""
    return F.substring_index(text, SEPARATOR, at)


def _joined(*columns: str) -> Column:
    return F.concat_ws(SEPARATOR, *columns)


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2, and 3 or more: by how many n-grams occur once to four times. FALLBACK where one of these
    numbers is 0 or an estimate isn't between 0 and its count."""
    t = table.filter("n <= 4").agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"t{k}") for k in range(1, 5))).first()
    if not all(t):
        return FALLBACK
    y = t[0] / (t[0] + 2 * t[1])
    found = tuple(k - (k + 1) * y * t[k] / t[k - 1] for k in range(1, 4))
    return found if all(0 <= d <= k for k, d in enumerate(found, 1)) else FALLBACK


def _sums(over=lambda c: c) -> dict[str, Column]:
    """Of the n-grams of a context: the sum of counts, and how many have a count of 1, of 2, and of 3 or more."""
    some = lambda when: F.count(F.when(when, 1))
    n = F.col("n")
    return {"total": over(F.sum("n")), "n1": over(some(n == 1)), "n2": over(some(n == 2)), "n3": over(some(n >= 3))}


def _share(d: tuple[float, float, float], n: str = "n", total: str = "total") -> Column:
    """What a count has after its discount, of its context's sum."""
    return (F.col(n) - F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])) / F.col(total)


def _left(d: tuple[float, float, float]) -> Column:
    """What discounts leave of a context for the order below."""
    return (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")


def _by_suffix(grams: DataFrame, whole: DataFrame | None, k: int) -> DataFrame:
    """Of n-grams (context, gram, n), their last k words as `key`, in several rows each: one for every n-gram that ends in it (its
    first word, n and its context's sums), before them one without `first` if it is a context itself, with its sums.

    `size` is the key's own count: of different words before it, and where a line begins with it the plain count. `is_head` marks one
    row of each key. `whole` (gram, n) counts lines of k words with their marks, which no longer n-gram has."""
    group = (Window.unboundedPreceding, Window.unboundedFollowing)
    context = Window.partitionBy("context").orderBy("gram")
    sums = _sums(lambda c: c.over(context.rowsBetween(*group)))
    rows = grams.withColumns({**sums, "at": F.row_number().over(context)})
    longer = F.struct("gram", "n", *sums)
    own = F.struct(F.concat(F.lit(SEPARATOR), "context").alias("gram"), F.lit(None).cast("long").alias("n"), *sums)
    rows = rows.select(F.explode(F.when(F.col("at") == 1, F.array(longer, own)).otherwise(F.array(longer))).alias("r")).select("r.*")
    if whole is not None:
        rows = rows.unionByName(whole.withColumn("gram", F.concat(F.lit(SEPARATOR), "gram")), allowMissingColumns=True)
    rows = rows.repartition(_part("gram", -k)).select(_part("gram", -k).alias("key"), F.nullif(_part("gram", 1), F.lit("")).alias("first"), "n", *sums)
    key = Window.partitionBy("key").orderBy(F.asc_nulls_first("first"), F.asc_nulls_first("n"))
    plain = F.sum(F.when(F.col("first").isNull(), F.coalesce("total", F.lit(0)) + F.coalesce("n", F.lit(0))))
    size = F.when(_part("key", 1) == BEGIN_CODE, plain.over(key.rowsBetween(*group))).otherwise(F.count("first").over(key.rowsBetween(*group)))
    return rows.withColumns({"size": size, "is_head": F.row_number().over(key) == 1})


def _heads(keys: DataFrame, k: int) -> DataFrame:
    """context, gram, n: a row for each key of k words."""
    return keys.filter("is_head").select(_part("key", k - 1).alias("context"), F.col("key").alias("gram"), F.col("size").alias("n"))


def _of_words(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """rows joined with a table of words for each of these columns: with the coded words of each, CODES at most, where they are sent to
    all tasks, and with all of them where one of a row's words is spelt out."""
    rare = F.lit(False)
    for c in tables:
        rare = rare | _is_rare(c)
    often, seldom = rows.filter(~rare), rows.filter(rare)
    for c, table in tables.items():
        often, seldom = often.join(F.broadcast(table.filter(~_is_rare(c))), c), seldom.join(table, c)
    return often.unionByName(seldom)


def kneser_ney(lines: DataFrame, words: str, order: int = 3, cut=lambda df, name: df, book: DataFrame | None = None) -> DataFrame:
    """order, w1 … wn (null above the n-gram's own order), p, back: an interpolated model with modified Kneser-Ney discounts.

    The highest order has plain counts. Below, n is the number of different words that an n-gram follows; n-grams at a line's begin
    follow nothing, so theirs are plain counts. The mark of begin is no unigram.

    `words` is an array column; empty and null ones are left out, repeated lines count each. p is a probability after the words
    before, back the factor for words that never follow this n-gram (1 if it is no context; null in the highest order). The
    unigrams hold UNKNOWN, whose p is what unigrams leave, dealt evenly over all words, END and UNKNOWN; BEGIN is never predicted and
    has p = 1, as files of such models say. Without any line there are no rows.

    Words travel as codes (`book` as codes() gives it, by default of these lines). The n-grams of the highest order are dealt twice: by
    the words before the last, and with the sums of these by the words after the first. `cut` writes a table between jobs."""
    if order < 2:
        raise ValueError("models have 2 orders at least")
    names = _names(order)
    rows = lines.filter(F.size(words) > 0)
    book = cut(codes(rows.select(F.explode(words).alias("word"))) if book is None else book, "codes")
    runs = _coded(grams_of(rows, words, order), names, book).select(_joined(*names).alias("gram")).repartition(_part("gram", order - 1))
    grams = runs.groupBy(_part("gram", order - 1).alias("context"), "gram").agg(F.count("*").alias("n"))
    by_key = {}
    for k in range(order - 1, 1, -1):
        short = _coded(grams_of(rows.filter(F.size(words) == k - 2), words, k), _names(k), book) if k > 2 else None  # k marks in all
        whole = short.groupBy(_joined(*_names(k)).alias("gram")).agg(F.count("*").alias("n")) if k > 2 else None
        by_key[k] = cut(_by_suffix(grams, whole, k), f"keys{k}")
        grams = _heads(by_key[k], k)
    pairs = (grams if order > 2 else cut(grams, "pairs")).select(_part("gram", 1).alias("x"), _part("gram", -1).alias("y"), "n")
    after = cut(pairs.groupBy("x").agg(*(c.alias(name) for name, c in _sums().items())), "after")
    single = cut(pairs.groupBy("y").agg(F.count("*").alias("n")), "single")
    d1, d2 = discounts(single), discounts(pairs)
    whole = single.agg(*(c.alias(name) for name, c in _sums().items()), (F.count("*") + 1).alias("size")).filter("total is not null")
    whole = whole.select("total", "size", _left(d1).alias("left"))
    first = single.join(F.broadcast(whole)).select("y", (_share(d1) + F.col("left") / F.col("size")).alias("p1"))  # one row of sums
    first = cut(first, "p1")
    marks = whole.select(F.lit(SPELT + UNKNOWN).alias("y"), (F.col("left") / F.col("size")).alias("p1")).unionByName(whole.select(F.lit(BEGIN_CODE).alias("y"), F.lit(1.0).alias("p1")))
    back = after.select(F.col("x").alias("y"), _left(d2).alias("back"))
    out = [first.unionByName(marks).join(back, "y", "left").select(F.col("y").alias("gram"), F.col("p1").alias("p"), F.coalesce("back", F.lit(1.0)).alias("back"))]
    tables = {"x": after.select("x", F.col("total").alias("of"), _left(d2).alias("left")), "y": first}
    p2 = _share(d2, "n" if order == 2 else "size", "of") + F.col("left") * F.col("p1")
    if order == 2:
        out.append(_of_words(pairs, tables).select(_joined("x", "y").alias("gram"), p2.alias("p"), F.lit(1.0).alias("back")))
    else:
        split = by_key[2].withColumns({"x": _part("key", 1), "y": _part("key", -1)})
        level = _of_words(split, tables).withColumn("p", p2)
    for k in range(2, order):
        d = discounts(by_key[k].filter("first is not null"))
        is_context = F.col("first").isNull() & F.col("total").isNotNull()
        own = F.struct(F.col("key").alias("gram"), "p", F.when(is_context, _left(d)).otherwise(1.0).alias("back"))
        longer = F.struct(_joined("first", "key").alias("gram"), (_share(d) + _left(d) * F.col("p")).alias("p"), F.lit(1.0).alias("back"))
        none = F.array().cast("array<struct<gram:string,p:double,back:double>>")
        each = F.when(F.col("is_head"), F.array(own)).otherwise(none)
        if k + 1 == order:
            each = F.concat(each, F.when(F.col("first").isNotNull(), F.array(longer)).otherwise(none))
        out.append(level.select(F.explode(each).alias("g")).select("g.*"))
        if k + 1 < order:
            known = level.filter("first is not null").select(longer.alias("r")).select(F.col("r.gram").alias("key"), "r.p")
            level = by_key[k + 1].join(cut(known, f"p{k + 1}"), "key")
    coded = reduce(DataFrame.unionByName, out).withColumn("w", F.split("gram", SEPARATOR))
    coded = coded.select(F.size("w").alias("order"), *(F.get("w", F.lit(i)).alias(name) for i, name in enumerate(names)), "p", "back")
    return _decoded(coded, names, book).select("order", *names, "p", F.when(F.col("order") < order, F.col("back")).alias("back"))


def gram(model: DataFrame) -> Column:
    """The words of a model's row as one text."""
    return F.concat_ws(SEPARATOR, *(c for c in model.columns if c.startswith("w")))


def _bits(order: int) -> int:
    return min(BITS, 63 // order)


def _packed(numbers: list[Column], bits: int) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(x, bits * i) for i, x in enumerate(reversed(numbers))))


def _numbered(rows: DataFrame, names: list[str], book: DataFrame, bits: int, *keep: str) -> DataFrame:
    """g, s: the words of these columns as one number; n-grams with a word that has none have g = -1, and s has their words as text."""
    known = book.filter(F.col("number") < 1 << bits)
    for name in names:
        rows = rows.join(F.broadcast(known.select(F.col("word").alias(name), F.col("number").alias(f"__{name}"))), name, "left")
    numbers = [F.col(f"__{name}") for name in names]
    is_whole = reduce(lambda a, b: a & b, (x.isNotNull() for x in numbers))
    text = F.concat_ws(SEPARATOR, *(F.coalesce(x.cast("string"), _spelt(name)) for x, name in zip(numbers, names, strict=True)))
    return rows.select(*keep, F.when(is_whole, _packed(numbers, bits)).otherwise(-1).alias("g"), F.when(is_whole, "").otherwise(text).alias("s"))


def _taken(n: int, k: int, bits: int) -> tuple[Column, Column]:
    """g and s of so many words of n-grams of n words, from the left, or from the right if negative."""
    size = abs(k)
    number = F.shiftright("g", bits * (n - k)) if k > 0 else F.col("g").bitwiseAND(F.lit((1 << bits * size) - 1))
    text = F.substring_index("s", SEPARATOR, k)
    is_spelt = (F.col("g") < 0) & F.contains(text, F.lit(SPELT))
    again = _packed([F.split_part(text, F.lit(SEPARATOR), F.lit(i)).try_cast("long") for i in range(1, size + 1)], bits)
    return F.when(F.col("g") >= 0, number).when(is_spelt, -1).otherwise(again), F.when(is_spelt, text).otherwise("")


def _named(parts: tuple[Column, Column], of: str = "") -> list[Column]:
    return [c.alias(f"{of}{name}") for c, name in zip(parts, "gs", strict=True)]


def write_arpa(model: DataFrame, path: str) -> None:
    """The model as an ARPA text, in part files whose order of names is the text's order.

    Lines are sorted over all tasks by section and n-gram; only the numbers of n-grams of each order, a few rows, are put before them."""
    highest = len([c for c in model.columns if c.startswith("w")])
    number = lambda c: F.format_string("%.7f", F.log10(c))
    line = F.concat_ws("\t", number(F.col("p")), gram(model), F.when(F.col("order") < highest, number(F.col("back"))))
    rows = model.select("order", F.lit(1).alias("part"), gram(model).alias("gram"), line.alias("value"))
    spark = model.sparkSession
    heads = [(0, 0, "", "\\data\\")] + [(k, 0, "", f"\n\\{k}-grams:") for k in range(1, highest + 1)] + [(highest + 1, 0, "", "\n\\end\\")]
    fixed = spark.createDataFrame(heads, "order int, part int, gram string, value string")
    sizes = model.groupBy("order").agg(F.count("*").alias("n")).select(F.lit(0).alias("order"), F.col("order").alias("part"), F.lit("").alias("gram"), F.format_string("ngram %d=%d", "order", "n").alias("value"))
    rows.unionByName(fixed).unionByName(sizes).orderBy("order", "part", "gram").select("value").write.text(path)


def read_arpa(spark: SparkSession, path: str, order: int = 3) -> DataFrame:
    """A model from ARPA files, as kneser_ney() gives it (numbers as they were written). An n-gram's order is its number of words."""
    fields = F.split("value", "\t")
    words = F.split(F.get(fields, F.lit(1)), SEPARATOR)
    n = F.size("w")
    rows = spark.read.text(path).filter(F.size(fields) >= 2).select(fields.alias("f"), words.alias("w"))
    power = lambda i: F.pow(F.lit(10.0), F.get("f", F.lit(i)).cast("double"))
    back = F.when(n < order, F.coalesce(power(2), F.lit(1.0)))
    return rows.select(n.alias("order"), *(F.get("w", F.lit(i)).alias(f"w{i + 1}") for i in range(order)), power(0).alias("p"), back.alias("back"))


def _asked(lines: DataFrame, words: str, key: str, order: int) -> DataFrame:
    """__key, w1 to w<order>: an n-gram for each word of the lines and for their ends, which it ends with. The first words of a line have
    shorter contexts, with empty words before them."""
    pads = F.array_repeat(F.lit(""), order - 2).cast("array<string>")
    rows = lines.filter(F.size(words) > 0).select(F.col(key).alias("__key"), F.concat(pads, F.array(F.lit(BEGIN)), words, F.array(F.lit(END))).alias("w"))
    n = F.size("w") - order + 1
    return rows.select("__key", F.inline(F.arrays_zip(*(F.slice("w", i, n) for i in range(1, order + 1)))).alias(*_names(order)))


def _line_sums(scored: DataFrame, key: str) -> DataFrame:
    sums = scored.groupBy("__key").agg(F.sum("times").alias("n_words"), F.sum(F.when(F.col("is_known"), 0).otherwise(F.col("times"))).alias("n_unknown"), F.sum(F.col("times") * F.col("log10")).alias("log10_p"))
    return sums.withColumnRenamed("__key", key)


def score(lines: DataFrame, words: str, model: DataFrame, key: str, cut=lambda df, name: df) -> DataFrame:
    """key, n_words, n_unknown, log10_p: for each row with a word at least, the words of the array column `words` and the line's end, with END
    counted and its share of the sum. Words that the model doesn't know get UNKNOWN's probability.

    Each different n-gram of the lines is looked up once: in the order below where it is missing, times the factor of its context. Rows
    with one key are one line for the sums."""
    order = len([c for c in model.columns if c.startswith("w")])
    names = _names(order)
    known = model.filter((F.col("order") == 1) & ~F.col("w1").isin(BEGIN)).select("w1")
    found = cut(_asked(lines, words, key, order).groupBy("__key", *names).agg(F.count("*").alias("times")), "found")
    asked = found.select(*names).distinct()
    last = names[-1]
    result = asked.join(known.select(F.col("w1").alias(last), F.lit(True).alias("is_known")), last, "left")
    result = result.withColumn("is_known", F.coalesce("is_known", F.lit(False))).withColumn("word", F.when(F.col("is_known"), F.col(last)).otherwise(UNKNOWN))
    result = result.join(model.filter("order = 1").select(F.col("w1").alias("word"), F.col("p").alias("so_far")), "word")
    for k in range(2, order + 1):
        context = names[order - k : -1]
        factors = model.filter(F.col("order") == k - 1).select(*(F.col(f"w{i}").alias(c) for i, c in enumerate(context, 1)), F.col("back").alias("factor"))
        direct = model.filter(F.col("order") == k).select(*(F.col(f"w{i}").alias(c) for i, c in enumerate(names[order - k :], 1)), F.col("p").alias("direct"))
        result = result.join(direct, names[order - k :], "left").join(factors, context, "left")
        result = result.withColumn("so_far", F.coalesce("direct", F.col("so_far") * F.coalesce("factor", F.lit(1.0)))).drop("direct", "factor")
    scored = found.join(result.select(*names, "is_known", F.log10("so_far").alias("log10")), names)
    return _line_sums(scored, key)


def score_by(lines: DataFrame, words: str, key: str, taught: DataFrame, taught_words: str, order: int = 3, cut=lambda df, name: df, book: DataFrame | None = None) -> DataFrame:
    """What score() gives for the lines by the model that kneser_ney() makes of the column `taught_words` of `taught`, without that model.

    All n-grams of `taught` are counted, in all orders. Probabilities are made for the n-grams of the lines alone: these travel with the
    others as rows without a count (`held`), so that each meets its own count and its context's sums where they are made. An n-gram that
    `taught` doesn't have gets its context's factor times the order below, which is the same sum with a share of 0.

    N-grams are numbers of 63 bits at most, words without a number are spelt out. Contexts of two words and more are each in one task."""
    if order < 2:
        raise ValueError("models have 2 orders at least")
    names, bits = _names(order), _bits(order)
    rows = taught.filter(F.size(taught_words) > 0)
    book = cut(codes(rows.select(F.explode(taught_words).alias("word"))) if book is None else book, "codes")
    found = cut(_numbered(_asked(lines, words, key, order), names, book, bits, "__key").groupBy("__key", "g", "s").agg(F.count("*").alias("times")), "found")
    runs = _numbered(grams_of(rows, taught_words, order), names, book, bits).select("g", "s", F.lit(1).alias("n"))
    runs = runs.unionByName(found.select("g", "s", F.lit(0).alias("n")))
    grams = {}
    for k in range(order, 0, -1):
        counts = (F.sum("n").alias("n"), F.bool_or(F.col("n") == 0 if k == order else F.col("held")).alias("held"))
        context = _taken(k, k - 1, bits) if k > 1 else None
        if k > 2:
            dealt = runs.repartition(*context).groupBy(*_named(context, "context_"), "g", "s").agg(*counts)
            group = Window.partitionBy("context_g", "context_s")
            sums = {name: F.when(F.col("held"), c) for name, c in _sums(lambda c: c.over(group)).items()}
            grams[k] = cut(dealt.withColumns(sums).drop("context_g", "context_s"), f"counts{k}")
        else:
            grams[k] = cut(runs.groupBy("g", "s").agg(*counts), f"counts{k}")
        seen = grams[k].filter("n > 0")
        if k == 2:
            contexts = seen.select(*_named(context, "context_"), "n").groupBy("context_g", "context_s").agg(*(c.alias(name) for name, c in _sums().items()))
        if k > 1:
            runs = grams[k].select(*_named(_taken(k, 1 - k, bits)), F.when(F.col("n") > 0, 1).otherwise(0).cast("long").alias("n"), "held")
        if k > 2:
            begin = _taken(k, 1, bits)[0] == BEGIN_NUMBER  # such n-grams follow nothing: plain counts
            runs = runs.unionByName(seen.filter(begin).select(*_named(context), "n", F.lit(False).alias("held")))
        if k > 3:
            short = _numbered(grams_of(rows.filter(F.size(taught_words) == k - 3), taught_words, k - 1), names[: k - 1], book, bits)
            runs = runs.unionByName(short.select("g", "s", F.lit(1).cast("long").alias("n"), F.lit(False).alias("held")))
    d = {k: discounts(grams[k]) for k in grams}
    share = lambda k: F.when(F.col("n") > 0, _share(d[k])).otherwise(0.0)
    whole = grams[1].filter("n > 0").agg(*(c.alias(name) for name, c in _sums().items()), (F.count("*") + 1).alias("size")).filter("total is not null")
    whole = whole.select("total", "size", _left(d[1]).alias("left"))
    result = grams[1].filter("held").join(F.broadcast(whole)).select("g", "s", (F.col("n") > 0).alias("is_known"), (share(1) + F.col("left") / F.col("size")).alias("p"))  # one row of sums
    for k in range(2, order + 1):
        below = result.select(F.col("g").alias("below_g"), F.col("s").alias("below_s"), "is_known", F.col("p").alias("below"))
        asked = grams[k].filter("held").withColumns(dict(zip(("below_g", "below_s"), _taken(k, 1 - k, bits), strict=True)))
        if k == 2:
            asked = asked.withColumns(dict(zip(("context_g", "context_s"), _taken(k, 1, bits), strict=True))).join(contexts, ["context_g", "context_s"], "left")
        factor = F.when(F.col("total") > 0, _left(d[k])).otherwise(1.0)
        result = asked.join(below, ["below_g", "below_s"]).select("g", "s", "is_known", (share(k) + factor * F.col("below")).alias("p"))
    return _line_sums(found.join(result.select("g", "s", "is_known", F.log10("p").alias("log10")), ["g", "s"]), key)
