"""Operator 3. Line dedup with a log-template tree, in DataFrame operations only.

Lines descend a tree of fixed depth: by their number of tokens, then by their
leading tokens; tokens with digits are variables from the start. The most frequent
line of a leaf is a template. Lines that agree with it but for a small share of their
tokens belong to it: where they differ, the template has a variable field, however often
each value occurs. The lines that are left make further templates in the same way, as many
as there are; what agrees with none is a template of its own. Where a template occurs in several documents,
the lines of the first one stay and those of the others are dropped.

Only keys of lines travel. Tokens do so for leaves that hold several lines of several
documents, once for each distinct line. Which lines those are, and which documents
lose any, is told by a table of bits of fixed size that every task gets; it may name
too many of them, never too few.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.common import fresh, key_bits, store, with_named
from spanwise.operators.skew import attach_group_stats, attach_summary, block_join

#: What stands for a variable token.
WILD = "<*>"
#: Leading tokens that the lines of a leaf have in common.
DEPTH = 3
#: Share of a line's tokens that may differ from its template.
VARIABLE = 0.2
#: Stretches that lines are cut into by the number of their tokens that may differ; with more of those, one more than these.
STRETCHES = {1: 6, 2: 6, 3: 6, 4: 6, 5: 7}
#: Lines with fewer tokens are never dropped, unless they have so many characters.
MIN_TOKENS = 3
MIN_CHARACTERS = 20
#: Lines, and tokens of them all, of a leaf that one task takes.
FEW_LINES = 100
FEW_TOKENS = 100_000
#: Rows of one line, leaf or template from which they are spread over tasks.
SPREAD_ROWS = 8_192

_BLANK = " \t\r\f"


def _tokens(line: Column) -> Column:
    """Tokens between blanks; those with a digit are one variable, unless they are more than half of the line."""
    other = line.contains("\t") | line.contains("\r") | line.contains("\f")
    # Splitting at a single character is several times as fast as by a pattern.
    plain = F.array_remove(F.split(F.when(other, F.translate(line, _BLANK, " " * len(_BLANK))).otherwise(line), " "), "")
    masked = F.transform(plain, lambda t: F.when(t.rlike("[0-9]"), WILD).otherwise(t))
    wild = F.size(F.filter(masked, lambda t: t == WILD))
    return F.when(line.rlike("[0-9]") & (2 * wild <= F.size(plain)), masked).otherwise(plain)


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int, min_characters: int) -> DataFrame:
    """`id` and `text_key` (together a row), `at`, `leaf`, `line_key` and the `tokens` behind it.

    Lines that stay in any case have leaf 0.
    """
    text = named(text_col).cast("string")
    split = docs.select(
        named(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("at", "line")
    )
    long = F.length(F.btrim("line", F.lit(_BLANK))) >= min_characters
    tokens = split.select("id", "text_key", "at", _tokens(F.col("line")).alias("tokens"), long.alias("long"))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))
    counts = (F.size("tokens") >= min_tokens) | F.col("long")
    return tokens.select(
        "id", "text_key", "at", F.when(counts, leaf).otherwise(F.lit(0).cast("long")).alias("leaf"), F.xxhash64("tokens").alias("line_key"), "tokens"
    )


def _places(depth: int, variable: float) -> Column:
    """Keys of a line (`leaf`, `tokens`), of which any two lines of a leaf that agree have one in common.

    The tokens behind the leading ones are cut into stretches. Lines that differ in at most
    so many tokens are alike in all stretches but so many, and a key stands for such a choice of stretches.
    Lines in which no token may differ have no key.
    """
    size = F.size("tokens")
    off = F.floor(size * variable + 1e-9).cast("int")
    n = F.greatest(size - depth, F.lit(0))
    cuts = off + 1
    for differ, most in STRETCHES.items():
        cuts = F.when(off == differ, F.greatest(off + 1, F.least(n, F.lit(most)))).otherwise(cuts)

    def stretches(many: Column) -> Column:
        at = lambda i: F.floor(i * n / many).cast("int")
        return F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.xxhash64(F.slice("tokens", at(i) + depth + 1, at(i + 1) - at(i))))

    def choices(many: Column) -> Column:
        kept = F.transform(F.sequence(F.lit(0), off), lambda i: F.array(i))
        for differ, most in STRETCHES.items():
            for number in range(differ + 2, most + 1):
                chosen = [F.array(*[F.lit(i) for i in some]) for some in combinations(range(number), number - differ)]
                kept = F.when((off == differ) & (many == number), F.array(*chosen)).otherwise(kept)
        return kept

    def keys(many: Column, stretch: Column) -> Column:
        return F.transform(choices(many), lambda some: F.xxhash64("leaf", some, F.transform(some, lambda i: F.get(stretch, i))))

    each = _held(cuts, lambda many: _held(stretches(many), lambda stretch: keys(many, stretch)))
    return F.when(off < 1, F.array().cast("array<bigint>")).when(n <= off, F.array("leaf")).otherwise(each)


def _held(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _differ(tokens: Column, model: Column) -> Column:
    return F.size(F.filter(F.zip_with(tokens, model, lambda a, b: ~a.eqNullSafe(b)), lambda x: x))


def _in_turn(lines: DataFrame, variable: float) -> DataFrame:
    """`key` and `own` of lines (`leaf`, `low`, `tokens`, `key`, `best`) of leaves with few lines, by taking them one after another.

    `own` is the key of the template: the first one in order of `low`, `tokens` and `key` that the line agrees with,
    or `best`, if that is given and lower. A line with a `best` is no template.
    """
    found = lines.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("low", "tokens", "key", "best"))).alias("lines"))

    def fits(line: Column, model: Column) -> Column:
        return _differ(line["tokens"], model["tokens"]) <= F.floor(F.size(line["tokens"]) * variable + 1e-9)

    def add(models: Column, line: Column) -> Column:
        old = line["best"].isNotNull() | F.exists(models, lambda model: fits(line, model))
        return F.when(old, models).otherwise(F.array_append(models, F.struct(line["tokens"].alias("tokens"), line["key"].alias("key"))))

    def own(line: Column, models: Column) -> Column:
        first = F.get(F.filter(models, lambda model: fits(line, model)), F.lit(0))["key"]
        return F.struct(line["key"].alias("key"), F.when(line["best"].isNull(), first).otherwise(F.least(first, line["best"])).alias("own"))

    models = F.aggregate("lines", F.array().cast("array<struct<tokens: array<string>, key: bigint>>"), add)
    owns = _held(models, lambda held: F.transform("lines", lambda line: own(line, held)))
    return found.select(F.explode(owns).alias("o")).select("o.key", "o.own")


def _few(lines: DataFrame) -> DataFrame:
    """Add whether the leaf has `few` lines, short enough to be taken by one task."""
    sized = attach_group_stats(lines, ["leaf"], {"_lines": F.count("*"), "_tokens": F.sum(F.size("tokens"))}, SPREAD_ROWS)
    return sized.withColumn("few", (F.col("_lines") <= FEW_LINES) & (F.col("_tokens") <= FEW_TOKENS)).drop("_lines", "_tokens")


def _templates(worded: DataFrame, depth: int, variable: float) -> DataFrame:
    """`line_key` and `template` of lines (`leaf`, `line_key`, `tokens`, `n`) that agree with a template of their leaf.

    A leaf's templates are its most frequent line, the most frequent of the lines that do not agree with that, and so
    on until no line is left. A line belongs to the first one that it agrees with. Lines that agree with no other line may be left out.

    Leaves with few lines are taken one by one. All others are worked on at once, by keys of which lines that agree
    have one in common. A line that is first of the undecided ones at each of its keys is a template:
    no line before it can agree with it. Lines at whose keys a template was first are compared with it. One that agrees
    is no template itself, and meets further ones as long as there may be one before its own.
    """
    sized = store(_few(worded), "leaf-sizes")
    first_go = sized.filter("few").select("leaf", (-F.col("n")).alias("low"), "tokens", F.col("line_key").alias("key"), F.lit(None).cast("long").alias("best"))
    small = _in_turn(first_go, variable).select(F.col("key").alias("line_key"), F.col("own").alias("template"))
    worded = sized.filter("NOT few").drop("few")
    if worded.isEmpty():
        return small

    seats = store(worded.select("leaf", "line_key", F.explode(_places(depth, variable)).alias("place")), "places")
    shared = seats.groupBy("place").agg(F.min("line_key").alias("low"), F.max("line_key").alias("high")).filter("low <> high")
    seats = with_named(seats, F.col("place"), key_bits(shared, "place"), "may").filter("may").drop("may")
    ranked = worded.join(seats.select("leaf", "line_key").distinct(), ["leaf", "line_key"], "left_semi")
    # Numbers in the order of frequency, ties in order of tokens.
    ranked = store(ranked.orderBy(F.desc("n"), "tokens", "line_key").withColumn("rank", F.monotonically_increasing_id()), "ranked")
    seats = seats.join(ranked.select("leaf", "line_key", "rank"), ["leaf", "line_key"])
    seats = store(seats.select("rank", "place", F.lit(None).cast("long").alias("best")), "seats")

    fits = _differ(F.col("tokens"), F.col("model")) <= F.floor(F.size("tokens") * variable + 1e-9)
    models = ranked.select(F.col("rank").alias("head"), F.col("tokens").alias("model"))
    found = []
    while not seats.isEmpty():
        # Leaves of which few lines are left are taken one by one again.
        rest = store(_few(ranked.select("leaf", "rank", "tokens").join(seats.select("rank", "best").distinct(), "rank")), "rest")
        last = rest.filter("few").select("leaf", F.col("rank").alias("low"), "tokens", F.col("rank").alias("key"), "best")
        found.append(_in_turn(last, variable).select(F.col("key").alias("rank"), "own"))
        seats = seats.join(rest.filter("NOT few").select("rank"), "rank", "left_semi")

        heads = seats.groupBy("place").agg(F.min(F.when(F.col("best").isNull(), F.col("rank"))).alias("head"), F.count("*").alias("_n"))
        heads = heads.filter("head IS NOT NULL")
        met = attach_summary(seats, ["place"], heads, heads, ["head"], SPREAD_ROWS).filter("best IS NULL OR head < best")
        met = store(met, "heads")
        if met.isEmpty():
            break
        first = met.filter("best IS NULL").groupBy("rank").agg(F.min("head").alias("head")).filter("head = rank").select("head")
        first = store(first, "first")
        pairs = met.filter("head < rank").select("rank", "head").distinct()
        pairs = pairs.join(ranked.select("rank", "tokens"), "rank")
        agreeing = block_join(pairs, models.join(first, "head", "left_semi"), ["head"], SPREAD_ROWS).filter(fits)
        agreeing = store(agreeing.groupBy("rank").agg(F.min("head").alias("own")), "agreements")
        found += [first.select(F.col("head").alias("rank"), F.col("head").alias("own")), agreeing]
        left = met.join(first.select(F.col("head").alias("rank")), "rank", "left_anti").join(agreeing, "rank", "left")
        left = left.select("rank", "place", "head", F.least("best", "own").alias("best")).filter("best IS NULL OR head < best")
        seats = store(left.drop("head"), "seats")
    if not found:
        return small
    own = reduce(DataFrame.unionByName, found).groupBy("rank").agg(F.min("own").alias("own"))
    placed = ranked.select("rank", "line_key").join(own, "rank").select("line_key", "own")
    named_by = ranked.select(F.col("rank").alias("own"), F.col("line_key").alias("template"))
    return small.unionByName(block_join(placed, named_by, ["own"], SPREAD_ROWS).select("line_key", "template"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    variable: float = VARIABLE,
    min_tokens: int = MIN_TOKENS,
    min_characters: int = MIN_CHARACTERS,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """The documents with recurring lines taken out, and how many lines they had and lost (columns named by `counts`).

    A template's first document, by id and then by hash of its text, keeps its lines;
    lines recurring within one document alone stay. Blank lines, and lines with fewer than
    `min_tokens` tokens and `min_characters` characters, are never dropped. A row whose
    every other line is dropped stays, with what is left of its text. Rows alike in id and
    text are one document and come out alike; rows that share an id alone are separate
    rows of one document. Null and empty texts are returned as they are, with 0 lines
    dropped. Texts and lines of any length are handled whole. Other columns pass through;
    input columns with the names in `counts` are replaced. Writes intermediate tables of
    keys to the shared folder.
    """
    lines = _lines(docs, id_col, text_col, depth, min_tokens, min_characters)
    # Lines without a leaf are left out once keys are stored: a filter before would split every line twice.
    keys = store(lines.drop("tokens"), "line-keys").filter("leaf <> 0")
    one_id = F.struct("id")
    ends = [F.min(one_id).alias("first"), F.max(one_id).alias("last")]
    several = ~F.col("first").eqNullSafe(F.col("last"))
    leaves = keys.groupBy("leaf").agg(*ends, F.min("line_key").alias("low"), F.max("line_key").alias("high")).filter(several)
    leaves = store(leaves.select("leaf", (F.col("low") != F.col("high")).alias("mixed")), "leaves")

    leaf = F.col("leaf")
    keys = with_named(keys, leaf, key_bits(leaves, "leaf"), "may").filter("may").drop("may")
    home = F.min(F.struct("id", "text_key")).alias("home")
    kinds = keys.groupBy("leaf", "line_key").agg(F.count("*").alias("n"), *ends, home)
    kinds = store(kinds.join(leaves, "leaf"), "lines")
    worded = with_named(lines, leaf, key_bits(leaves.filter("mixed"), "leaf"), "may").filter("may").groupBy("leaf", "line_key").agg(F.first("tokens").alias("tokens"))
    worded = store(worded.join(kinds.filter("mixed").select("leaf", "line_key", "n"), ["leaf", "line_key"]), "tokens")
    templates = _templates(worded, depth, variable)

    of_line = store(kinds.join(templates, "line_key", "left").withColumn("template", F.coalesce("template", "line_key")), "templates")
    recurring = of_line.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("home").alias("home"))
    recurring = recurring.filter(several).select("template", "home")
    # Every line known here lies in a leaf of several documents; the rest has left by the bits or leaves now.
    placed = of_line.select("line_key", "template", F.col("n").alias("_n"))
    found = keys.join(leaves.select("leaf"), "leaf", "left_semi").select("id", "text_key", "at", "line_key")
    found = attach_summary(found, ["line_key"], placed, placed, ["template"], SPREAD_ROWS)
    gone = block_join(found.drop("line_key"), recurring, ["template"], SPREAD_ROWS).filter(~F.col("id").eqNullSafe(F.col("home.id")))
    gone = store(gone.groupBy("id", "text_key").agg(F.collect_set("at").alias("dropped")), "dropped")

    base = docs.drop(*counts)
    text = named(text_col).cast("string")
    bits = key_bits(gone.select(F.xxhash64("id", "text_key").alias("row")), "row")
    may = fresh(base, "may")
    # Only documents that may lose lines are moved to meet them.
    met = with_named(base, F.xxhash64(named(id_col), F.xxhash64(text)), bits, may)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias(counts[0])
    columns = [c for c in base.columns if c != text_col]
    its_id, its_text, its_lines = (fresh(met, c) for c in ("its_id", "its_text", "its_lines"))
    gone = gone.select(F.col("id").alias(its_id), F.col("text_key").alias(its_text), F.col("dropped").alias(its_lines))
    same = named(id_col).eqNullSafe(named(its_id)) & (F.xxhash64(text) == named(its_text))
    losing = met.filter(named(may)).join(gone, same, "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(named(its_lines), i)), "\n")
    losing = losing.select(
        *[named(c) for c in columns],
        F.when(named(its_lines).isNull(), text).otherwise(left).alias(text_col),
        n_lines,
        F.coalesce(F.size(named(its_lines)), F.lit(0)).cast("long").alias(counts[1]),
    )
    whole = met.filter(~named(may)).select(*[named(c) for c in columns], text.alias(text_col), n_lines, F.lit(0).cast("long").alias(counts[1]))
    return losing.unionByName(whole).select(*[named(c) for c in (*base.columns, *counts)])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The documents without recurring lines and with their own columns, whatever their names; those of which nothing is left go.

    A column `n_chars`, where there is one, is brought in line with the text.
    """
    counts = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    cut = dedup_lines(docs, id_col, text_col, counts=counts, **options)
    lost = named(counts[1]) > 0
    emptied = lost & ~named(text_col).rlike(r"\S")
    columns = [named(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        measured = F.when(lost, F.length(named(text_col)).cast(kind)).otherwise(F.col("n_chars"))
        columns = [measured.alias(c) if c == "n_chars" else named(c) for c in docs.columns]
    return cut.filter(~emptied).select(*columns)
