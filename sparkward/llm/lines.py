"""Removing lines that repeat an earlier line, exactly or nearly: an exact set-similarity join.

A line's tokens are its distinct words, or its distinct five-word shingles (words are what stands between
blanks, as written, or between white space, lower-cased; for shingles, a line of fewer words, but not none, is one token). One changed
word breaks five shingles, so near copies of fewer than 49 words are found by words only. Lines are
ordered by (doc_id, position). A line goes if an earlier line is equal, or if
100 * |intersection| >= percent * |union| of the tokens of the two, whether that earlier line stays or goes.

1. Equal lines are counted before anything else; all but the first are copies, and do
   not enter the join.
2. Tokens are put in order of rarity. How often each occurs is counted over all lines in
   BINS bins, a fixed number; any order gives the same result, a better one less work.
3. Only a line's prefix can hold the first token it shares with a line that similar. A token in at
   most RARE lines is a key by itself. Where no such token is shared, the rare ones are all among the
   few tokens in which the lines differ; in the order of the others, each such token parts at most two
   neighbours of its own line and one pair of the other's. So among a line's first 2 * spare + 1 pairs
   of neighbours, spare being the most tokens it may have alone, there is one that the other line has
   among its first ones too: these pairs are the keys. Their number grows with the tokens of a line, never
   with their square, and not with the table. Lines too short for that bound (at 80 percent,
   those of one token) keep their single tokens.
4. The length and positional filters drop pairs that cannot reach the threshold, and so do
   64 or 128 bits of each line: the bits in which two lines differ are never more than the tokens.
   A semi join over the keys leaves the lines that pass them with any other line, earlier or
   later; it makes a row at most for each key of a line, and only these rows, few in most
   texts, go on. Those that have an earlier line are looked at.
5. Such a line is first held against the earliest line of each of its keys. Lines that this
   doesn't decide are held against all earlier lines of the key, by a semi join that stops at
   the first that verifies. So a large group of near copies makes few rows, and no line is left out.
6. All is verified on the tokens themselves.

Lines of nothing but white space stay. A null text stays null. A row without doc_id is returned as
it is, and removes nothing. Rows that share a doc_id are taken as versions of one
document: a line and the same line at the same position of another version are one.
DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.llm.frames import discard, free_name, ids_and_texts, kept
from sparkward.llm.sketch import may_hold, sketch

SHINGLE, PERCENT = 5, 80
#: A token of at most RARE lines is a key by itself; one of more is a key with its neighbour in the order of rarity.
RARE = 1024
#: Lines of more tokens are told apart by 128 bits instead of 64.
FEW = 56
#: Rows that are verified within a join carry up to this many tokens.
CARRIED = 512
BINS = 1 << 22
#: How often a bin's tokens occur is told in this many classes, four for each doubling.
_CLASS_BITS = 7
_TOKEN_BITS = 40


def _let(value: Column, body) -> Column:
    """body(value), with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _evened(text: Column, folded: bool) -> Column:
    """Folded: lower-cased, with blanks for white space of other kinds but line ends. Line by line or over the whole text it is the same."""
    if not folded:
        return text
    low = F.lower(text)
    odd = reduce(or_, (F.contains(text, F.lit(c)) for c in "\t\x0B\f\r"))  # four searches cost far less than the regex, and most texts have none
    return F.when(odd, F.regexp_replace(low, r"[\t\x0B\f\r]", " ")).otherwise(low)


def _split(evened: Column) -> Column:
    return F.array_remove(F.split(evened, " "), "")


def _words(line: Column, folded: bool) -> Column:
    return _split(_evened(line, folded))


def _line_hash(line: Column, folded: bool) -> Column:
    return F.xxhash64(F.array_join(_words(line, folded), " ") if folded else line)


def _by_window(words: Column, of) -> Column:
    """of(the words of a window) for each window."""
    full = F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: of(*[F.get(words, i + j) for j in range(SHINGLE)])
    )
    return F.when(F.size(words) >= SHINGLE, full).otherwise(F.array(of(F.array_join(words, " "))))


def _token_hashes(words: Column, by_word: bool) -> Column:
    """One for each distinct token. Two of a line may get the same value; then a key of it is met twice, and no link is lost."""
    short = F.lit((1 << _TOKEN_BITS) - 1)
    whole = F.transform(F.array_distinct(words), lambda w: F.xxhash64(w)) if by_word else F.array_distinct(_let(words, lambda w: _by_window(w, F.xxhash64)))
    return F.transform(whole, lambda t: t.bitwiseAND(short))


def _token_strings(words: Column, by_word: bool) -> Column:
    return F.array_distinct(words if by_word else _let(words, lambda w: _by_window(w, lambda *part: F.concat_ws(" ", *part))))


def _line_table(docs: DataFrame, by_word: bool, folded: bool) -> DataFrame:
    """Every line with a word, its hashes and its tokens' hashes: doc_id, pos, h, g, tokens. Texts are cut up once."""
    lines = docs.select("doc_id", F.posexplode(F.split(_evened(F.col("text"), folded), "\n")).alias("pos", "line"))
    words = F.col("words")
    own = F.array_join(words, " ") if folded else F.col("line")
    worded = lines.select("doc_id", "pos", "line", _split(F.col("line")).alias("words"))
    worded = worded.filter(F.size(words) > 0 if folded else F.col("line").rlike(r"\S"))
    return kept(
        worded.select("doc_id", "pos", F.xxhash64(own).alias("h"), F.xxhash64(F.lit(7), own).alias("g"), _token_hashes(words, by_word).alias("tokens")),
        "line-table",
    )


def _repeated(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, g, first) of lines that occur more than once, and (doc_id, pos, h) of all but the first of each."""
    firsts = lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
    repeated = kept(firsts.filter("n > 1").select("h", "g", "first"), "repeated-lines")
    keyed = lines.select("doc_id", "pos", "h", "g")
    copies = keyed.join(repeated, ["h", "g"]).filter(F.struct("doc_id", "pos") != F.col("first")).select("doc_id", "pos", "h")
    return repeated, kept(copies, "copies")


def _firsts(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Every line but the copies; only lines that may be repeated are shuffled."""
    hit = may_hold(kept(sketch(repeated, "h"), "repeated-sketch"), "h")
    known = lines.filter(hit).join(repeated, ["h", "g"], "left")
    first = known.filter(F.col("first").isNull() | (F.struct("doc_id", "pos") == F.col("first")))
    return first.select("doc_id", "pos", "tokens").unionByName(lines.filter(~hit).select("doc_id", "pos", "tokens"))


def _with_positions(docs: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """`docs` with the places (pos, h) of each document as an array `name`, a free one; documents without any are not shuffled."""
    doc = free_name([*docs.columns, name], "_doc")
    by_doc = kept(places.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("pos", "h")).alias(name)), "places")
    hit = may_hold(kept(sketch(by_doc, doc), "places-sketch"), "doc_id")
    none = F.array().cast("array<struct<pos: int, h: bigint>>")
    named = docs.filter(hit).join(by_doc, F.col("doc_id") == F.col(doc), "left").drop(doc)
    named = named.withColumn(name, F.coalesce(F.col(name), none))
    return named.unionByName(docs.filter(~F.coalesce(hit, F.lit(False))).withColumn(name, none))


def _kept_positions(lines: Column, places: Column, folded: bool) -> Column:
    """Positions of the lines that stay, in order."""
    gone = F.filter(places, lambda p: _line_hash(F.get(lines, p["pos"]), folded) == p["h"])
    return F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(gone, lambda p: p["pos"]))


def _class(n: int) -> int:
    return min((1 << _CLASS_BITS) - 1, int(4 * math.log2(1 + n)))


def _rarity_classes(lines: DataFrame) -> DataFrame:
    """One row, one column `classes`: the class of each of the BINS bins, eight to a long."""
    token = lines.select(F.explode("tokens").alias("t"))
    seen = token.groupBy(F.pmod("t", F.lit(BINS)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    own = F.least(F.lit((1 << _CLASS_BITS) - 1), F.floor(4 * F.log2(1 + F.col("n")))).cast("long")
    put = F.call_function("shiftleft", own, (F.col("bin") % 8 * 8).cast("int"))
    packed = seen.groupBy((F.col("bin") / 8).cast("int").alias("word")).agg(F.sum(put).alias("bits"))
    every = lines.sparkSession.range(BINS // 8).select(F.col("id").cast("int").alias("word"))
    dense = every.join(packed, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    return dense.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("classes"))


def _prefixes(lines: DataFrame, repeated: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id, pos, n_i, sig, more): the keys of every line that is no copy.

    n_i holds its number of tokens and the place of the key's first token; sig has a bit for each token, bits of two
    tokens cancel out. Over FEW tokens 64 bits say little: there more has the half of 128 bits that folds into sig.
    """
    # A subquery must not stand in a lambda. As a column that is used once Spark puts it there itself, and no row holds the table.
    firsts = _firsts(lines, repeated).withColumn("classes", kept(_rarity_classes(lines), "rarity").scalar())

    def key(t: Column) -> Column:
        word, place = F.shiftright(t.bitwiseAND(F.lit(BINS - 1)), 3), F.shiftleft(t.bitwiseAND(F.lit(7)), 3)
        own = F.call_function("shiftright", F.get("classes", word.cast("int")), place.cast("int")).bitwiseAND(F.lit((1 << _CLASS_BITS) - 1))
        return F.call_function("shiftleft", own, F.lit(_TOKEN_BITS)).bitwiseOR(t)

    def bits(upper: bool) -> Column:
        """64 bits of the tokens, or of those whose seventh bit is set."""

        def put(x: Column, t: Column) -> Column:
            with_it = x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int")))
            return F.when(t.bitwiseAND(F.lit(64)) == 64, with_it).otherwise(x) if upper else with_it

        return F.aggregate("tokens", F.lit(0).cast("long"), put)

    # Order by rarity; a line's words of one line only come first, then its other rare ones, then the crowded ones.
    ranked = firsts.select(
        "doc_id", "pos", F.sort_array(F.transform("tokens", key)).alias("keys"),
        bits(False).alias("sig"), F.when(F.size("tokens") > FEW, bits(True)).alias("more"),
    )
    n = F.size("keys")
    need = F.ceil(n * percent / 100).cast("int")
    counted = ranked.select(
        "doc_id", "pos", "keys", "sig", "more", n.alias("n"), (n - need).alias("spare"),
        _upto("keys", _class(1)).alias("own"), _upto("keys", _class(RARE)).alias("rare"),
    )
    n, spare, own, rare = (F.col(c) for c in ("n", "spare", "own", "rare"))
    # A pair of similar lines that share no rare token has two neighbours in common if one of the lines is `sure`.
    sure = n - 1 >= 2 * spare + 1
    ends = F.when(sure, F.least(rare, spare + 1)).otherwise(spare + 1)
    alone = F.slice("keys", own + 1, F.greatest(F.lit(0), ends - own))
    pairs = F.greatest(F.lit(0), F.least(2 * (spare - rare) + 1, n - rare - 1))
    twos = F.zip_with(F.slice("keys", rare + 1, pairs), F.slice("keys", rare + 2, pairs), lambda k, k2: F.xxhash64(k, k2).bitwiseOR(F.lit(-(1 << 63))))
    dealt = counted.select("doc_id", "pos", "sig", "more", "n", "own", F.posexplode(F.concat(alone, twos)).alias("at", "key"))
    # neighbours say nothing of the place of the first shared token
    place = F.when(F.col("key") >= 0, F.col("own") + F.col("at")).otherwise(0).cast("long")
    return dealt.select("key", "doc_id", "pos", F.call_function("shiftleft", n.cast("long"), F.lit(32)).bitwiseOR(place).alias("n_i"), "sig", "more")


def _upto(keys: str, most: int) -> Column:
    """How many of a line's keys are of class `most` or a rarer one."""
    return F.size(F.filter(keys, lambda k: k < ((most + 1) << _TOKEN_BITS)))


def _may_match(a, b, percent: int) -> Column:
    """Length, positional and bit filters for lines that share a key; a and b give their n_i, sig and more."""
    n_a, n_b = (F.shiftright(x("n_i"), 32).cast("int") for x in (a, b))
    i_a, i_b = (x("n_i").bitwiseAND(F.lit((1 << 32) - 1)).cast("int") for x in (a, b))
    need = percent * (n_a + n_b)
    folded, upper = a("sig").bitwiseXOR(b("sig")), a("more").bitwiseXOR(b("more"))
    unlike = F.coalesce(F.bit_count(upper) + F.bit_count(folded.bitwiseXOR(upper)), F.bit_count(folded))
    return (
        ((100 + percent) * unlike <= (100 - percent) * (n_a + n_b))
        & (100 * n_a >= percent * n_b)
        & (100 * n_b >= percent * n_a)
        & ((100 + percent) * (n_a - i_a) >= need)
        & ((100 + percent) * (n_b - i_b) >= need)
    )


def _tokens(docs: DataFrame, ends: DataFrame, by_word: bool, folded: bool) -> DataFrame:
    """doc_id, pos, h and token strings of the lines at (doc_id, pos) of `ends`, cut again from their texts."""
    places = ends.distinct().withColumn("h", F.lit(0).cast("long"))
    wanted = _with_positions(docs, places, "wanted").filter(F.size("wanted") > 0)
    picked = wanted.select(
        "doc_id",
        F.explode(_let(F.split("text", "\n"), lambda x: F.transform("wanted", lambda p: F.struct(p["pos"].alias("pos"), F.get(x, p["pos"]).alias("line"))))).alias("l"),
    )
    worded = picked.select("doc_id", "l.pos", "l.line").filter(F.col("line").rlike(r"\S"))
    strings = _token_strings(_words(F.col("line"), folded), by_word)
    return kept(worded.select("doc_id", "pos", _line_hash(F.col("line"), folded).alias("h"), strings.alias("tokens")), "tokens")


def _similar(a: Column, b: Column, percent: int) -> Column:
    """Whether two arrays of distinct tokens reach the threshold."""
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= percent * (F.size(a) + F.size(b) - shared)


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, by_word: bool, folded: bool) -> DataFrame:
    """(doc_id, pos, h) of the later lines of the pairs that reach the threshold."""
    pairs = kept(pairs.distinct(), "pairs")
    ends = pairs.select("doc_id", "pos").unionByName(pairs.select(F.col("e_doc").alias("doc_id"), F.col("e_pos").alias("pos")))
    tokens = _tokens(docs, ends, by_word, folded)
    other = tokens.select(F.col("doc_id").alias("e_doc"), F.col("pos").alias("e_pos"), F.col("tokens").alias("others"))
    both = pairs.join(tokens, ["doc_id", "pos"]).join(other, ["e_doc", "e_pos"])
    out = kept(both.filter(_similar(F.col("tokens"), F.col("others"), percent)).select("doc_id", "pos", "h").distinct(), "verified")
    discard(pairs, tokens)
    return out


def _joined(a: DataFrame, b: DataFrame, how: str, percent: int, *more: Column, later: str | None = "a") -> DataFrame:
    """Rows of a and rows of b that share a key and pass the filters, those of `later` being the later lines, or of either order."""
    a, b = a.alias("a"), b.alias("b")
    if later is None:
        both = (F.col("a.doc_id") != F.col("b.doc_id")) | (F.col("a.pos") != F.col("b.pos"))
    else:
        e = "b" if later == "a" else "a"
        both = (F.col(f"{e}.doc_id") < F.col(f"{later}.doc_id")) | ((F.col(f"{e}.doc_id") == F.col(f"{later}.doc_id")) & (F.col(f"{e}.pos") < F.col(f"{later}.pos")))
    for x in (_may_match(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), percent), *more):
        both &= x
    return a.join(b, (F.col("a.key") == F.col("b.key")) & both, how)


def _verified_in_groups(docs: DataFrame, undecided: DataFrame, linked: DataFrame, percent: int, by_word: bool, folded: bool) -> DataFrame:
    """(doc_id, pos, h) of undecided lines that reach the threshold with an earlier line of their key other than its pivot.

    Semi joins leave the rows on either side that pass the filters with any of the other. These carry their tokens and the
    last join verifies, so that a line gives a row at most for each of its keys, however large their groups. A line of over
    CARRIED tokens has too many keys for that; such lines, few, are paired.
    """
    fresh = F.struct("b.doc_id", "b.pos") != F.col("a.pivot")
    rest = kept(_joined(undecided, linked, "left_semi", percent, fresh), "rest")
    mates = kept(_joined(linked, rest, "left_semi", percent, later="b"), "mates")
    n = F.shiftright("n_i", 32)
    short, others = rest.filter(n <= CARRIED), mates.filter(percent * n <= 100 * CARRIED)
    tokens = _tokens(docs, short.select("doc_id", "pos").unionByName(others.select("doc_id", "pos")), by_word, folded)
    a, b = (x.join(tokens, ["doc_id", "pos"]) for x in (short, others))
    similar = _similar(F.col("a.tokens"), F.col("b.tokens"), percent)
    out = kept(_joined(a, b, "left_semi", percent, similar).select("doc_id", "pos", "h").distinct(), "verified")
    discard(tokens)
    long = rest.filter(n > CARRIED)
    if not long.isEmpty():
        pairs = _joined(long, mates, "inner", percent).select("a.doc_id", "a.pos", F.col("b.doc_id").alias("e_doc"), F.col("b.pos").alias("e_pos"))
        out = out.unionByName(_verified(docs, pairs, percent, by_word, folded))
    discard(rest, mates)
    return out


def _near(docs: DataFrame, lines: DataFrame, repeated: DataFrame, percent: int, by_word: bool, folded: bool) -> DataFrame:
    """(doc_id, pos, h) of lines that are no copies and have an earlier similar line."""
    prefixes = kept(_prefixes(lines, repeated, percent), "prefixes")
    discard(lines)
    # both lines of a pair, so that all that follows reads these rows only
    linked = kept(_joined(prefixes, prefixes, "left_semi", percent, later=None), "linked-prefixes")
    discard(prefixes)
    open_ = kept(_joined(linked, linked, "left_semi", percent), "open-prefixes")
    pivots = linked.groupBy("key").agg(F.min(F.struct("doc_id", "pos", "n_i", "sig", "more")).alias("pivot"))
    held = kept(open_.join(pivots, "key"), "held")
    discard(open_)
    e_doc, e_pos = F.col("pivot.doc_id"), F.col("pivot.pos")
    by_pivot = held.filter(_may_match(F.col, lambda c: F.col(f"pivot.{c}"), percent)).select("doc_id", "pos", e_doc.alias("e_doc"), e_pos.alias("e_pos"))
    first = _verified(docs, by_pivot, percent, by_word, folded)
    undecided = held.withColumn("pivot", F.struct(e_doc.alias("doc_id"), e_pos.alias("pos"))).join(first, ["doc_id", "pos"], "left_anti")
    undecided = kept(undecided, "undecided")
    out = first if undecided.isEmpty() else first.unionByName(_verified_in_groups(docs, undecided, linked, percent, by_word, folded))
    discard(linked, held, undecided)
    return out


def removed_lines(docs: DataFrame, percent: int = PERCENT, by_word: bool = True, folded: bool = True) -> DataFrame:
    """(doc_id, pos, h) of every line that goes."""
    read = ids_and_texts(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = _line_table(read, by_word, folded)
    repeated, copies = _repeated(lines)
    return copies.unionByName(_near(read, lines, repeated, percent, by_word, folded))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, by_word: bool = True, folded: bool = True, removed: str = "_removed") -> DataFrame:
    """`docs` with `text` less the lines that go; other columns as they were, and last the positions `removed`.

    by_word: tokens are a line's distinct words, not its shingles. folded: words are lower-cased and
    stand between white space of any kind, and lines of the same words in the same order are equal.
    If `docs` has a column called as `removed`, it stays, and the new one's name ends with an underscore more.
    """
    name = free_name(docs.columns, removed)
    own = free_name([*docs.columns, name], "_gone")
    out = free_name([*docs.columns, name, own], "_out")
    gone = _with_positions(docs, removed_lines(docs, percent, by_word, folded), own)
    both = _let(
        F.split("text", "\n"),
        lambda x: _let(
            _kept_positions(x, F.col(own), folded),
            lambda at: F.struct(
                F.array_join(F.transform(at, lambda i: F.get(x, i)), "\n").alias("text"),
                F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), at)).alias("removed"),
            ),
        ),
    )
    touched = F.when(F.col("text").isNotNull() & (F.size(own) > 0), both)
    names = [F.coalesce(f"{out}.text", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return gone.withColumn(out, touched).select(*names, F.coalesce(f"{out}.removed", F.array().cast("array<int>")).alias(name))
