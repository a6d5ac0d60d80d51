"""Spelling variants by a frequency-vector trie.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case. A word's vector counts its code points per
letter group; the trie has one level per group, and a node's children differ in that group's count. One inserted code
point is a surplus of one in one group, one deleted a deficit of one, one replaced a surplus and a deficit or, within a
group, neither. A depth-first search therefore spends one deficit and one surplus at most on its way down, and the
words at the leaves it reaches are compared letter by letter. The search runs from the longer word, and for equal lengths
from the one whose first difference is a deficit, so that it finds each pair once.

The upper levels of the trie deal the words to tasks: a word is stored at its node of depth ``d`` and searches from all
nodes of that depth within its budget. ``d`` grows with the vocabulary until no node has over ``NODE_WORDS`` words; should the
deepest level not do, the words of a full node and those that search it are cut into blocks, and every two blocks meet.

A word is ``near`` another at exactly one edit. Its ``form`` is the near word of largest count (ties: the first in code-point
order), if that count is at least ``RATIO`` times its own; ``root`` follows the forms to the last.

Null and empty texts have no words; a null doc_id is written as nothing where it is hashed. Rows that repeat count again. Texts and
words may be of any length. Columns other than doc_id and text are not read, so their names do not matter. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stayledger.functions.sizing import small
from stayledger.sources.tables import materialize

MIN_LETTERS, MIN_COUNT, RATIO = 7, 2, 10
#: One in so many occurrences loses a letter before it is counted, by hash; 0 for none.
NOISE = 31
#: Letter groups, one to a level of the trie: common letters in pairs, then alone, rare ones together; accented ones by their number.
GROUPS = ("en", "ai", "rs", "to", "l", "d", "u", "c", "h", "m", "p", "g", "b", "f", "v", "kw", "yjqxz")
LEVELS = len(GROUPS) + 2
DEPTHS = (4, 6, 8, 10, 12)
NODE_WORDS, BUCKET_WORDS = 15_000, 4_000
#: Up to so many pairs of words below a node are compared at once; above, the search goes down another level.
DIRECT = 1 << 16
#: Letters of a word that are kept as a row for comparisons; longer words are compared one by one.
WIDTH = 32
_DIGIT = 32


def _group_of_byte() -> np.ndarray:
    """The group of each Latin-1 code; accented letters go to the last two by odd and even."""
    codes = np.arange(256)
    group = np.where(codes % 2, LEVELS - 2, LEVELS - 1)
    for level, letters in enumerate(GROUPS):
        group[[ord(x) for x in letters]] = level
    return group


_GROUP = _group_of_byte()


# --- words ---------------------------------------------------------------------------------------------------------

def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def with_slips(doc_id: Column, word: Column, noise: int = NOISE) -> Column:
    """The word, less one letter where the hash of document and word says so."""
    if not noise:
        return word
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    without = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(F.pmod(h, F.lit(noise)) == 0, without).otherwise(word)


def vocabulary(docs: DataFrame, noise: int = NOISE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of at least ``min_letters`` letters that occur at least ``min_count`` times."""
    # A shorter run cannot give a long enough word, and the greedy pattern takes longer ones whole.
    runs = F.regexp_extract_all(F.col("text"), F.lit(rf"[A-Za-zÀ-ÿ]{{{min_letters},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", lowered(F.col("run")).alias("run"))
    counted = words.select(with_slips(F.col("doc_id"), F.col("run"), noise).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.length("word") >= min_letters))


# --- the trie over Spark -------------------------------------------------------------------------------------------

def _digits(depth: int) -> list[Column]:
    """Counts of the first groups, modulo the base of a key's digits."""
    def count(letters: str) -> Column:
        return F.length("word") - F.length(F.translate("word", letters, ""))
    return [F.pmod(count(g), F.lit(_DIGIT)).cast("long") for g in GROUPS[:depth]]


def _key(digits: list[Column]) -> Column:
    key = F.lit(0).cast("long")
    for d in digits:
        key = key * _DIGIT + d
    return key


def _depth(words: DataFrame) -> tuple[int, int, int]:
    """The least depth at which no node is too large (else the deepest), its largest node, and the number of words."""
    deepest = DEPTHS[-1]
    full = words.select(_key(_digits(deepest)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("key", 5 * (deepest - d)).alias("node")) for d in DEPTHS]))
    nodes = full.select("n", levels.alias("at")).groupBy("at.depth", "at.node").agg(F.sum("n").alias("n"))
    sizes = {r.depth: (r.most, r.total) for r in nodes.groupBy("depth").agg(F.max("n").alias("most"), F.sum("n").alias("total")).collect()}
    if not sizes:
        return DEPTHS[0], 0, 0
    depth = next((d for d in DEPTHS if sizes[d][0] <= NODE_WORDS), deepest)
    return depth, *sizes[depth]


def _keyed(words: DataFrame, depth: int) -> DataFrame:
    """``words`` with its node as ``node``, and in ``_down`` and ``_up`` what a lost or added letter of each group adds to that key."""
    place = [_DIGIT ** (depth - 1 - i) for i in range(depth)]
    split = words.select("word", "n", *[d.alias(f"_{i}") for i, d in enumerate(_digits(depth))])

    def change(i: int, by: int) -> Column:
        return (F.pmod(F.col(f"_{i}") + by, F.lit(_DIGIT)) - F.col(f"_{i}")) * place[i]

    # A group without letters has none to lose; from 32 letters on a digit of 0 may stand for some.
    loses = [F.when((F.col(f"_{i}") > 0) | (F.length("word") >= _DIGIT), change(i, -1)) for i in range(depth)]
    return split.select("word", "n", _key([F.col(f"_{i}") for i in range(depth)]).alias("node"),
                        F.array(*loses).alias("_down"), F.array(*[change(i, 1) for i in range(depth)]).alias("_up"))


def _reachable(depth: int, of=lambda key: key) -> Column:
    """The nodes in which the partners of a word can lie: its own, one deficit away, or one deficit and a later surplus."""
    down, up = ([F.get(F.col(c), F.lit(i)) for i in range(depth)] for c in ("_down", "_up"))
    node = F.col("node")
    steps = [d for d in down] + [down[i] + up[j] for i in range(depth) for j in range(i + 1, depth)]
    return F.array_distinct(F.array_compact(F.array(of(node), *[F.when(s.isNotNull(), of(node + s)) for s in steps])))


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words at exactly one edit once: word, n, other, other_n. ``words`` is read several times: pass a written table."""
    depth, most, total = _depth(words)
    buckets = F.lit(max(1, -(-total // BUCKET_WORDS)))
    keyed = _keyed(words, depth)

    def bucket(node: Column) -> Column:
        return F.pmod(F.xxhash64(node), buckets)

    if most <= NODE_WORDS:
        # A word searches a bucket once, from its root.
        left = keyed.select("word", "n", bucket(F.col("node")).alias("block"))
        right = keyed.select("word", "n", F.explode(_reachable(depth, bucket)).alias("block"))
    else:
        left, right = _blocks(keyed.select("word", "n", "node"), keyed.select("word", "n", F.explode(_reachable(depth)).alias("node")), bucket)

    empty = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())]).empty_table()

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        q, w = Trie(Words(left.column("word"))).near(Words(right.column("query")))
        return pa.table({"word": right.column("query").take(q), "n": right.column("query_n").take(q),
                         "other": left.column("word").take(w), "other_n": left.column("n").take(w)})

    # Both sides come from one frame; the second needs columns of its own.
    right = right.select(F.col("word").alias("query"), F.col("n").alias("query_n"), F.col("block").alias("query_block"))
    return left.groupBy("block").cogroup(right.groupBy("query_block")).applyInArrow(search, "word string, n long, other string, other_n long")


def _blocks(stored: DataFrame, asking: DataFrame, bucket) -> tuple[DataFrame, DataFrame]:
    """Both sides, with nodes over ``NODE_WORDS`` cut on either side: a piece of stored words meets every piece of searching ones."""
    def pieces(rows: DataFrame, out: str) -> DataFrame:
        return rows.groupBy("node").agg(F.ceil(F.count("*") / NODE_WORDS).cast("long").alias(out)).where(F.col(out) > 1)

    cut = small(materialize(pieces(stored, "_rows").join(pieces(asking, "_cols"), "node", "full").fillna(1), "trie-cuts"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        full = rows.join(cut, "node", "left")
        hot, one = F.col(own).isNotNull(), F.lit(1).cast("long")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, one) - 1)).alias(other)
        placed = full.select("word", "n", "node", hot.alias("_hot"), F.pmod(F.xxhash64("word"), F.coalesce(own, one)).alias(own), each)
        # Nodes that are whole share buckets; a block of a cut one stands alone.
        block = F.when(F.col("_hot"), F.xxhash64("node", "_rows", "_cols")).otherwise(bucket(F.col("node")))
        return placed.select("word", "n", block.alias("block")).distinct()

    return dealt(stored, "_rows", "_cols"), dealt(asking, "_cols", "_rows")


# --- the trie in a task --------------------------------------------------------------------------------------------

class Words:
    """Words of a column as Latin-1 bytes: counts per letter group, first and last letters, and rows of letters from either edge."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        self.text = [x.encode("latin-1") for x in column.to_pylist()]
        n = len(self.text)
        self.length = np.fromiter(map(len, self.text), np.int64, n)
        flat = np.frombuffer(b"".join(self.text), np.uint8)
        row, first = np.repeat(np.arange(n), self.length), np.cumsum(self.length) - self.length
        self.counts = np.bincount(row * LEVELS + _GROUP[flat], minlength=n * LEVELS).reshape(n, LEVELS).astype(np.int32)
        at = np.arange(len(flat)) - first[row]
        self.left, self.right = np.zeros((n, WIDTH), np.uint8), np.zeros((n, WIDTH), np.uint8)
        for rows, place in ((self.left, at), (self.right, self.length[row] - 1 - at)):
            near = place < WIDTH
            rows[row[near], place[near]] = flat[near]

    def edges(self, letters: int) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last ``letters`` letters (4 at most), as one number each."""
        mask = np.uint32((1 << 8 * letters) - 1)
        return tuple(np.ascontiguousarray(x[:, :4]).view("<u4")[:, 0] & mask for x in (self.left, self.right))


class Trie:
    """A trie over the counts of stored words: a node is a level and a run of the sorted words."""

    def __init__(self, words: Words) -> None:
        self.words = words
        self.order = np.lexsort(words.counts.T[::-1])
        self.sorted = words.counts[self.order]

    def near(self, queries: Words) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored word) for all pairs at one edit in which the query is longer, or as long with a deficit first or the larger word."""
        none = np.zeros(0, np.int64)
        if not len(self.order) or not len(queries.text):
            return none, none
        # One edit leaves the first or the last half of the other letters alone.
        edge = min(4, int(queries.length.min() - 1) // 2)
        edges = queries.edges(edge), tuple(x[self.order] for x in self.words.edges(edge))
        found = [(none, none)]
        # A frame: level, first and last stored word, queries still alive, edits each has spent (1: the deficit, 2: the surplus too).
        stack = [(0, 0, len(self.order), np.arange(len(queries.text)), np.zeros(len(queries.text), np.int8))]
        while stack:
            level, lo, hi, alive, spent = stack.pop()
            if not len(alive):
                continue
            if level == LEVELS or (hi - lo) * len(alive) <= DIRECT:
                # A large leaf is met in slices of its queries.
                step = max(1, 16 * DIRECT // (hi - lo))
                for a in range(0, len(alive), step):
                    found.append(self._matches(queries, edges, level, lo, hi, alive[a:a + step], spent[a:a + step]))
                continue
            column, mine = self.sorted[lo:hi, level], queries.counts[alive, level]
            cuts = np.flatnonzero(np.diff(column)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), hi - lo]):
                fits, after = _spend(column[a] - mine, spent)
                stack.append((level + 1, lo + a, lo + b, alive[fits], after[fits]))
        q, w = (np.concatenate(x) for x in zip(*found))
        return q, w

    def _matches(self, queries: Words, edges: tuple, level: int, lo: int, hi: int, alive: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified pairs below a node: an edge in common, the rest of the way down within the budget, then letter by letter."""
        (first, last), (stored_first, stored_last) = edges
        like = (first[alive][:, None] == stored_first[lo:hi]) | (last[alive][:, None] == stored_last[lo:hi])
        q, w = np.nonzero(like)
        w, state = w + lo, spent[q]
        q = alive[q]
        for at in range(level, LEVELS):
            fits, after = _spend(self.sorted[w, at] - queries.counts[q, at], state)
            q, w, state = q[fits], w[fits], after[fits]
        w = self.order[w]
        ok = _one_edit(queries, q, self.words, w)
        for k in np.flatnonzero(ok & (state == 0)).tolist():
            # Words of one vector meet in both directions.
            ok[k] = queries.text[q[k]] > self.words.text[w[k]]
        return q[ok], w[ok]


def _spend(change: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which changes of a count the budgets still allow, and what is spent after them."""
    fits = (change == 0) | ((change == -1) & (spent == 0)) | ((change == 1) & (spent == 1))
    return fits, spent + (change != 0).astype(np.int8)


def _one_edit(longer: Words, q: np.ndarray, shorter: Words, w: np.ndarray) -> np.ndarray:
    """Whether the pairs are at exactly one edit: one letter of the longer word lies outside the common start and end."""
    n, m = longer.length[q], shorter.length[w]
    differ = longer.left[q] != shorter.left[w]
    start = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    differ = longer.right[q] != shorter.right[w]
    end = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    ok = ((n != m) | (start < m)) & (np.minimum(start, m) + np.minimum(end, m) >= n - 1)
    for k in np.flatnonzero(n > WIDTH).tolist():
        ok[k] = _one_edit_long(longer.text[q[k]], shorter.text[w[k]])
    return ok


def _one_edit_long(a: bytes, b: bytes) -> bool:
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[at + 1:] == (b[at:] if len(a) > len(b) else b[at + 1:]) and a != b


# --- forms and roots -----------------------------------------------------------------------------------------------

def variants(docs: DataFrame, noise: int = NOISE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = materialize(vocabulary(docs, noise, min_letters, min_count), "variant-words")
    pairs = near_pairs(words)
    sides = F.explode(F.array(F.struct("word", "n", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
                              F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    found = pairs.select(sides.alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    far = F.when(-F.col("best.order") >= ratio * F.col("n"), 1)
    named = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far == 1, F.col("best.near")).alias("form"), F.when(far == 1, -F.col("best.order")).alias("form_n"))
    named = materialize(named, "variant-forms")
    roots = _roots(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(forms: DataFrame) -> DataFrame:
    """The last form of each word that has one. Each round doubles the steps, and a chain is as long as counts can grow by ``RATIO``."""
    while True:
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        forms = materialize(forms.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "variant-roots")
        moved = forms.where("_moved").isEmpty()
        forms = forms.drop("_moved")
        if moved:
            return forms
