"""Spelling variants: words that differ by one inserted, deleted or replaced character, and the frequent form that each is a variant of.

A word with one error agrees with its neighbour before or behind the middle. So every word is looked up twice: its first half is matched
exactly in an automaton of words read forwards and the rest is completed with one error, and its second half is matched in an automaton of words
read backwards. Words are dealt out by the half that must match, so an automaton has all words that can complete it; it is minimal and acyclic, and the
numbers of the words below its edges add up to a word's place (a perfect hash), by which counts are found. Halves that very many words share are matched with half
of the rest in addition, in rounds. An error is taken at its leftmost place only, so that no pair is found twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import MULT, Scratch, mix, partitions, tidy

#: Words of one automaton, and the most code points that their matrix has.
CHUNK, CHUNK_CELLS = 30_000, 4 << 20
#: Entries up to which an automaton has a table of all states and labels.
DENSE = 1 << 24
LETTERS = "A-Za-zÀ-ÿ"


def letter_runs(docs: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """(id, run): every maximal run of Latin letters of at least so many code points, A-Z in lower case."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.split(text_col, f"[^{LETTERS}]+")).alias("run")).filter(F.length("run") >= least_length)
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return runs.select("id", F.when(F.col("run").rlike("[A-Z]"), low).otherwise(F.col("run")).alias("run"))


def words_of(runs: DataFrame, least_length: int = 1, least: int = 1) -> DataFrame:
    """(word, n) of rows with a column `word`: those of at least `least_length` code points that occur at least `least` times."""
    return runs.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def looked_up(size: Column, lo: Column, hi: Column) -> list[Column]:
    """How a word takes part in the search of words of `size` code points with an error in their places lo to hi: as `path`, which must
    match, and `rest`. With the first places in question, words are read backwards."""
    tail = size - hi  # code points behind, which must match
    front = F.substr("word", F.lit(1), lo)
    back = F.substr("word", F.length("word") - tail + 1, tail)
    rest = F.substr("word", lo + 1, F.length("word") - tail - lo)
    backwards = (lo == 0) & (hi < size)
    path = F.when(backwards, F.reverse(back)).when(hi == size, front).otherwise(F.concat(back, F.lit("\0"), front))
    return [path.alias("path"), F.when(backwards, F.reverse(rest)).otherwise(rest).alias("rest")]


def halves(words: DataFrame) -> DataFrame:
    """Rows (word, n, size, lo, hi, asked): each word takes part in the searches of words that are as long, or one longer or shorter; the one of
    its own length is its own search (asked)."""
    sizes = F.explode(F.sequence(F.greatest(F.length("word") - 1, F.lit(1)), F.length("word") + 1)).alias("size")
    rows = words.select("word", "n", sizes)
    middle = F.floor(F.col("size") / 2).cast("int")
    parts = F.array(F.struct(middle.alias("lo"), F.col("size").alias("hi")), F.struct(F.lit(0).alias("lo"), middle.alias("hi")))
    rows = rows.select("word", "n", "size", F.explode(parts).alias("part")).select("word", "n", "size", "part.*", (F.length("word") == F.col("size")).alias("asked"))
    return rows.filter("hi > lo")


KEY = ["size", "lo", "hi", "path"]


def near_words(words: DataFrame, *, most_group: int = 50_000) -> DataFrame:
    """(word, n, n_near, near, near_n) of each word of rows (word, n): how many other words differ from it by exactly one inserted, deleted or
    replaced code point, and the one of largest n (ties: smallest in code-point order), null if there is none.

    words: distinct; null and empty ones are left out. most_group: words of up to 16 code points (fewer of longer ones) that share a matched half and are searched in
    one task; larger groups match half of what is left in addition, until one place is left, where a group has as many words as there are pairs of characters.
    An empty table gives none.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.put(words.filter("word <> ''").select("word", "n"), "words")
    rows, found, k = halves(words), [], 0
    while True:
        keyed = rows.select("word", "n", "size", "lo", "hi", "asked", *looked_up(F.col("size"), F.col("lo"), F.col("hi")))
        keyed = keyed.withColumn("h", F.xxhash64("path"))
        sizes = keyed.groupBy("size", "lo", "hi", "h").agg(F.count("*").alias("m"))
        hot = scratch.put(sizes.filter((F.col("m") * F.greatest("size", F.lit(16)) > 16 * most_group) & (F.col("hi") - F.col("lo") > 1)).drop("m"), f"hot{k}")
        many, group = not hot.isEmpty(), ["size", "lo", "hi", "h"]
        found.append(scratch.put(complete(keyed.join(hot, group, "left_anti") if many else keyed), f"near{k}"))
        if not many:
            break
        again = keyed.join(hot, group, "left_semi")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        again = again.select("word", "n", "size", F.explode(parts).alias("part"), "asked").select("word", "n", "size", "part.*", "asked")
        rows, k = scratch.put(again, f"rows{k}"), k + 1
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:bigint,near:string>").alias("best"))
    for near in found:
        none = none.unionByName(near.select("word", "n", "n_near", F.struct((-F.col("near_n")).alias("less"), "near").alias("best")))
    out = none.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of strings as code points and their offsets."""
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


class Automaton:
    """The minimal acyclic automaton of distinct strings, which are rows of labels (0 to `width` - 1, each row's first `lengths`) that begin at a root of
    their own kind (0, 1, ...). An edge knows its target (0: none) and how many words of its source come before those that it leads to; so what a word's
    edges know adds up, from its kind's base, to its number: 0 to n - 1, each once."""

    def __init__(self, kinds: np.ndarray, labels: np.ndarray, lengths: np.ndarray, width: int):
        n, most = labels.shape
        self.width = width
        roots, node = np.unique(kinds, return_inverse=True)
        # the trie, level by level: its edges are the distinct (node, label)
        made, parents, letters, levels = len(roots), [], [], [np.arange(len(roots))]
        final = [np.zeros(len(roots), bool)]
        ends = lengths == 0
        final[0][node[ends]] = True
        alive = np.flatnonzero(~ends)
        for k in range(most):
            if not len(alive):
                break
            edges, to = np.unique(node[alive] * width + labels[alive, k].astype(np.int64), return_inverse=True)
            parents.append(edges // width)
            letters.append(edges % width)
            node[alive] = made + to
            levels.append(np.arange(made, made + len(edges)))
            end = lengths[alive] == k + 1
            done = np.zeros(len(edges), bool)
            done[to[end]] = True
            final.append(done)
            made += len(edges)
            alive = alive[~end]
        final = np.concatenate(final)
        parent = np.concatenate([*parents, np.zeros(0, np.int64)]).astype(np.int64)
        letter = np.concatenate([*letters, np.zeros(0, np.int64)]).astype(np.int64)
        child = np.arange(len(roots), made)
        # nodes of equal heights that are equally final and have the same edges to the same states are one state
        height = np.zeros(made, np.int64)
        for level in reversed(levels[1:]):
            at = level - len(roots)
            np.maximum.at(height, parent[at], height[child[at]] + 1)
        state = np.full(made, -1, np.int64)
        by_height = np.argsort(height[parent], kind="stable")
        cut = np.searchsorted(height[parent][by_height], np.arange(height.max() + 2))
        by_node = np.argsort(height, kind="stable")
        cut_node = np.searchsorted(height[by_node], np.arange(height.max() + 2))
        states, first, place = 1, [np.zeros(0, np.int64)], np.zeros(made, np.int64)  # state 0: none
        for h in range(int(height.max()) + 1):
            nodes = by_node[cut_node[h] : cut_node[h + 1]]
            edges = by_height[cut[h] : cut[h + 1]]
            a, b = np.zeros((2, len(nodes)), np.uint64)
            place[nodes] = np.arange(len(nodes))
            reached = mix(letter[edges].astype(np.uint64) * MULT + state[child[edges]].astype(np.uint64))
            np.add.at(a, place[parent[edges]], reached)
            np.add.at(b, place[parent[edges]], mix(reached ^ MULT))
            order = np.lexsort((final[nodes], b, a))
            new = np.ones(len(nodes), bool)
            new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (final[nodes][order][1:] != final[nodes][order][:-1])
            state[nodes[order]] = states + np.cumsum(new) - 1
            first.append(nodes[order[new]])
            states += int(new.sum())
        first = np.concatenate(first)  # a node of each state from 1 on
        self.final = np.concatenate([[False], final[first]])
        keeps = np.zeros(made, bool)
        keeps[first] = True
        kept = keeps[parent]
        source, target, label = state[parent[kept]], state[child[kept]], letter[kept]
        order = np.argsort(source * width + label)
        source, target, label = source[order], target[order], label[order]
        self.root = state[: len(roots)]
        self.first = np.searchsorted(source, np.arange(states + 1))  # a state's edges, in order of their labels
        self.label, self.target = label, target
        below = self.final.astype(np.int64)  # words that a state leads to
        from_height = height[first[source - 1]]
        upwards = np.argsort(from_height, kind="stable")
        for own in np.split(upwards, np.searchsorted(from_height[upwards], np.arange(2, int(height.max()) + 1))):
            np.add.at(below, source[own], below[target[own]])
        before = np.cumsum(below[target]) - below[target]
        self.before = before - before[np.minimum(self.first[source], max(len(before) - 1, 0))] + self.final[source]
        self.base = np.cumsum(below[self.root]) - below[self.root]  # of the numbers of each kind
        self.keys = source * width + label
        self.table = None
        if states * width <= DENSE:
            self.table = np.full(states * width, -1, np.int32)
            self.table[self.keys] = np.arange(len(self.keys))

    def walk(self, state: np.ndarray, number: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step on; label -1 leads nowhere (state 0)."""
        key = state * self.width + labels
        if self.table is not None:
            edge = self.table[key]
            ok = (labels >= 0) & (edge >= 0)
        else:
            edge = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            ok = (labels >= 0) & (self.keys[edge] == key) if len(self.keys) else np.zeros(len(key), bool)
        if not len(self.keys):
            return np.zeros(len(key), np.int64), number
        return np.where(ok, self.target[edge], 0), np.where(ok, number + self.before[edge], number)


def complete(keyed: DataFrame) -> DataFrame:
    """(word, n, n_near, near, near_n) of the searches (asked) among rows (word, n, asked, size, lo, hi, path, rest): what a word's rest is completed to
    with one error after its path, within the rows of the same key."""

    def search(table: pa.Table) -> pa.RecordBatch:
        word, n = table["word"].combine_chunks(), table["n"].to_numpy()
        size, lo, hi = (table[c].to_numpy().astype(np.int64) for c in ("size", "lo", "hi"))
        asked = table["asked"].to_numpy()
        a, a_at = code_points(table["path"].combine_chunks())
        b, b_at = code_points(table["rest"].combine_chunks())
        of_path, of_rest = np.diff(a_at), np.diff(b_at)
        lengths = of_path + of_rest
        alphabet, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = np.full((len(word), int(lengths.max()) + 2), -1, np.int32)  # two columns more, so that a step beyond the end finds -1
        row = np.repeat(np.arange(len(word)), of_path)
        labels[row, np.arange(len(a)) - a_at[row]] = codes[: len(a)]
        row = np.repeat(np.arange(len(word)), of_rest)
        labels[row, np.arange(len(b)) - b_at[row] + of_path[row]] = codes[len(a) :]
        # rows of other keys never meet: of other paths by their labels, of other searches by their roots
        kinds = np.unique(np.stack([size, lo, hi, of_path]), axis=1, return_inverse=True)[1].reshape(-1)
        own = Automaton(kinds, labels, lengths, len(alphabet))
        state, number = own.root[kinds], own.base[kinds]
        # every word's number, and the state and number after its path
        q = np.flatnonzero(asked)
        at_state, at_number = state[q].copy(), number[q].copy()
        for k in range(int(lengths.max())):
            more = lengths > k
            state[more], number[more] = own.walk(state[more], number[more], labels[more, k])
            here = of_path[q] == k + 1
            at_state[here], at_number[here] = state[q[here]], number[q[here]]
        by_number = np.empty(len(word), np.int64)
        by_number[number] = np.arange(len(word))
        backwards = (lo == 0) & (hi < size)
        found_q, found_row = [], []
        s, start, back, whole = of_rest[q], of_path[q], backwards[q], hi[q] == size[q]
        for i in range(int(s.max()) + 1 if len(q) else 0):
            on = np.flatnonzero(s >= i)  # searches whose first i places of the rest are matched
            st, nu, p = at_state[on], at_number[on], start[on] + i
            here = labels[q[on], p]  # -1 at the end
            before = np.where(p > 0, labels[q[on], np.maximum(p - 1, 0)], -1)
            after = labels[q[on], p + 1]
            # dropped: this character is one too many; leftmost: it differs from the one before, or, backwards, from the one behind
            lost = (i < s[on]) & np.where(back[on], (i + 1 == s[on]) | (after != here), before != here)
            c_q, c_state, c_number, c_at = [on[lost]], [st[lost]], [nu[lost]], [p[lost] + 1]
            # any edge instead of this character, or before it
            degree = own.first[st + 1] - own.first[st]
            edge = np.repeat(own.first[st] - (np.cumsum(degree) - degree), degree) + np.arange(degree.sum())
            of = np.repeat(np.arange(len(on)), degree)
            to, number_to, label = own.target[edge], nu[of] + own.before[edge], own.label[edge]
            swap = (here[of] >= 0) & (label != here[of])
            b_of = back[on][of]
            place = np.where(b_of, i > 0, (i < s[on][of]) | whole[on][of])
            put = place & (label != np.where(b_of, here[of], before[of]))
            for ok, step in ((swap, 1), (put, 0)):
                c_q.append(on[of[ok]])
                c_state.append(to[ok])
                c_number.append(number_to[ok])
                c_at.append(p[of[ok]] + step)
            c_q, c_state, c_number, c_at = map(np.concatenate, (c_q, c_state, c_number, c_at))
            # the rest of each candidate exactly
            while len(c_q):
                ended = c_at == lengths[q[c_q]]
                good = ended & own.final[c_state]
                found_q.append(c_q[good])
                found_row.append(by_number[c_number[good]])
                c_q, c_state, c_number, c_at = c_q[~ended], c_state[~ended], c_number[~ended], c_at[~ended]
                c_state, c_number = own.walk(c_state, c_number, labels[q[c_q], c_at])
                live = c_state > 0
                c_q, c_state, c_number, c_at = c_q[live], c_state[live], c_number[live], c_at[live] + 1
            # one character of the word itself
            go = i < s
            at_state[go], at_number[go] = own.walk(at_state[go], at_number[go], labels[q[go], start[go] + i])
        found_q, found_row = np.concatenate([*found_q, np.zeros(0, np.int64)]), np.concatenate([*found_row, np.zeros(0, np.int64)])
        rank = pc.rank(word, tiebreaker="dense").to_numpy()
        order = np.lexsort((rank[found_row], -n[found_row], found_q))
        found_q, found_row = found_q[order], found_row[order]
        top = np.flatnonzero(np.diff(found_q, prepend=-1))
        counts = np.diff(np.append(top, len(found_q)))
        mine, best = q[found_q[top]], found_row[top]
        columns = [word.take(pa.array(mine)), pa.array(n[mine]), pa.array(counts), word.take(pa.array(best)), pa.array(n[best])]
        return pa.RecordBatch.from_arrays(columns, ["word", "n", "n_near", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            """Groups of words, whole, as many as an automaton takes."""
            nonlocal waiting, held
            table = pa.Table.from_batches(waiting).combine_chunks()
            h = table["key"].to_numpy()
            starts = np.flatnonzero(np.diff(h, prepend=h[0] ^ 1))  # of groups; the last may go on in the next batch
            ends = np.append(starts[1:], len(h))
            if not last:
                ends = ends[:-1]
            wide = pc.add(pc.utf8_length(table["path"]), pc.utf8_length(table["rest"])).to_numpy() + 2
            at = 0
            while at < (ends[-1] if len(ends) else 0):
                among = ends[ends > at]
                cells = np.maximum.accumulate(wide[at : among[-1]])[among - at - 1] * (among - at)
                fits = (among - at <= CHUNK) & (cells <= CHUNK_CELLS)
                end = int(among[max(int(np.argmin(fits)) if not fits.all() else len(fits), 1) - 1])
                if end - at > 1:  # one row alone finds nothing
                    yield search(table.slice(at, end - at))
                at = end
            rest = table.slice(at)
            waiting, held = rest.to_batches(), rest.num_rows

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                held += batch.num_rows
                if held >= 2 * CHUNK:
                    yield from ready(False)
        if held:
            yield from ready(True)
        tidy()

    key = F.xxhash64(*KEY).alias("key")
    # equal hashes of other keys only share an automaton, in which they don't meet
    dealt = keyed.select("word", "n", "asked", *KEY, "rest", key).repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("size", "key")
    return dealt.mapInArrow(run, "word string, n long, n_near long, near string, near_n long")


def spelling_variants(words: DataFrame, *, times: int = 10, most_group: int = 50_000) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of rows (word, n): near_words(), and of the near word of largest n the form, if that n is
    at least `times` the word's own, else null. root: where the forms of forms end; a word without a form is its own.

    Forms grow by `times` each, so a chain has at most as many words as the largest n has digits (for times=10), and roots are found by doubling. times: at
    least 2, so that no chain comes back. Words are distinct and not null; an empty table gives none.
    """
    if times < 2:
        raise ValueError("times must be at least 2")
    scratch = Scratch(words.sparkSession, "forms")
    near = near_words(words, most_group=most_group)
    has = F.col("near_n") >= times * F.col("n")
    found = scratch.put(near.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    roots, k = scratch.put(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        onward = roots.select(F.col("word").alias("via"), F.col("root").alias("further"))
        longer = roots.join(onward, F.col("root") == F.col("via"), "left")
        step = scratch.put(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots{k + 1}")
        k += 1
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    out = found.join(roots.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
