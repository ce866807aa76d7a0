"""Line deduplication by an exact set-similarity join over the words of lines.

A line's tokens are its distinct words, ordered from rare to frequent.  Two lines
of Jaccard t or more share a token among their first words in that order: of the
longer one the first n - ceil(t n) + 1, of the shorter one the first
n - ceil(2 t n / (1 + t)) + 1.  Lines meet on these prefix tokens, sorted by size
there, so that each looks only at lines up to its size / t (length filter).  Pairs
pass a positional filter (what can still follow the token) and a parity filter (a bit
of a line's map tells whether an odd number of its words fall on it, so each bit that
differs is a word that one of two lines lacks) before their whole sets are compared.  A line goes if an equal or a similar line comes
earlier.

A set is told apart from others by 96 bits of hashes over its words besides its size:
32 in its name, and 64 that follow from its maps and so take no room in the
postings.  Parity maps of a few words say little, so lines of up to seven words carry
a whole hash in a map that lines of their size don't use.

Hot words: two similar lines that share one word of four or more share two.  Where
the first shared word is very frequent, so is the second, and lines meet on the
*pair* of words instead, among one more word of the prefix.  So no task gets all
lines that a frequent word has.

Rarity: exact counts are taken over all lines; the most frequent words are
ranked by them, and the others, rarer than every one of those, come first, by
hash.  Any order that is the same for all lines gives the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .staging import staged

#: frequent words that are ranked by count; the list is broadcast (16 bytes a word)
RANKED_WORDS = 65_536
#: occurrences from which a ranked word is no key alone, but in pairs
HOT_WORD = 100_000
#: set numbers that are broadcast to pick lines for the comparison; more are joined by shuffle
BROADCAST_SETS = 2_000_000
#: candidates of a line and key that are compared in each look, those that seem nearest first; only lines that have
#: matched none and have more go on to the next look, and the last one takes all
LOOKS = (1, 64, None)
#: words up to which a line has two parity maps of 64 bits, and one of 128; others have one of 256
MAP_WORDS = (60, 130)
#: words up to which a line's third map is a hash of the set
HASHED_WORDS = 7
#: rows of a task, and pairs of them, worked on at a time
BLOCK_ROWS, BLOCK_PAIRS = 100_000, 1_000_000
NEWLINE = ord("\n")
LAST = 2**63 - 1
SLOT_BITS = 20
#: a posting is one number: 32 bits of the key, the line's size, and the place of the key's word (255 or more are one)
SIZE_BITS, PLACE_BITS = 24, 8
MOST_WORDS, MOST_PLACE = (1 << SIZE_BITS) - 1, (1 << PLACE_BITS) - 1
LOW32 = np.uint64(0xFFFFFFFF)
#: distinct words that a task holds before it reduces its counts
HELD_WORDS = 2_000_000


def _lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line start offsets and the end, document of each line, number in its document).

    Every document has one line more than line feeds; a line keeps its line feed.
    """
    breaks = np.flatnonzero(buf == NEWLINE) + 1
    doc = np.concatenate((np.arange(len(offs) - 1), np.searchsorted(offs, breaks - 1, "right") - 1))
    start = np.concatenate((offs[:-1], breaks))
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return np.append(start, len(buf)), doc, number


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: occurrences over all lines, but for words that a task meets once only.

    These are rare, and rarer than any that the ranking is about; counts are short by
    one for each such task at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textvec.keep_freed_memory()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            word, n = (np.concatenate(x) for x in zip(*held))
            word, group = np.unique(word, return_inverse=True)
            return word, np.bincount(group, n, len(word)).astype(np.int64)

        for batch in batches:
            for _, _, buf, offs in textvec.chunks(batch):
                held.append(np.unique(textvec.words(buf, offs, textvec.NON_BLANK)[0], return_counts=True))
                if len(held) > 1 and sum(len(w) for w, _ in held) > HELD_WORDS:
                    word, n = reduced()
                    if len(word) > HELD_WORDS // 2:  # even so many: those met once go
                        yield _counted(word, n)
                        word, n = word[:0], n[:0]
                    held = [(word, n)]
        yield _counted(*reduced())
        textvec.release()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    on = n > 1
    return pa.RecordBatch.from_arrays([pa.array(word[on].view(np.int64)), pa.array(n[on].astype(np.int64))], ["word", "n"])


def frequent_words(docs: DataFrame, size: int = RANKED_WORDS) -> Broadcast:
    """(hashes, ranks, rank from which words are hot, a name of the list) of the most frequent words; rank 1 for the rarest of them."""
    top = word_counts(docs).orderBy(F.desc("n"), "word").limit(size).toArrow()
    ranks = np.arange(top.num_rows, 0, -1)
    hot = ranks[top["n"].to_numpy() >= HOT_WORD]
    return docs.sparkSession.sparkContext.broadcast((top["word"].to_numpy().view(np.uint64), ranks, int(hot.min()) if len(hot) else 1 << 40, uuid.uuid4().hex))


class Ranks:
    """Ranks of words by the upper bits of their hash; of words in one slot the most frequent has a rank."""

    def __init__(self, words: np.ndarray, ranks: np.ndarray, hot: int):
        self.hot = hot
        self.word = np.zeros(1 << SLOT_BITS, np.uint64)
        self.rank = np.zeros(1 << SLOT_BITS, np.int64)
        slot = (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.word[slot[::-1]], self.rank[slot[::-1]] = words[::-1], ranks[::-1]

    def of(self, token: np.ndarray) -> np.ndarray:
        slot = (token >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        return np.where(self.word[slot] == token, self.rank[slot], 0)


class LineSets:
    """Distinct words of a chunk's lines, from rare to frequent, and each set's name, parity maps and size.

    A name is the size and 32 bits of a hash; with the 64 bits of ``ident`` it tells sets apart.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, ranks: Ranks):
        self.starts, self.doc, self.number = _lines(buf, offs)
        token, at, _, _ = textvec.words(buf, offs, textvec.NON_BLANK)
        line = np.searchsorted(self.starts[:-1], at, "right") - 1
        order = ranks.of(token)
        by = None
        if len(self.doc) < 1 << 18:
            brief = line.astype(np.uint64) << np.uint64(46) | order.astype(np.uint64) << np.uint64(29) | token >> np.uint64(35)
            by = np.argsort(brief)
            near = brief[by]
            if ((near[1:] == near[:-1]) & (token[by][1:] != token[by][:-1])).any():
                by = None  # two words that the shortened hash takes for one
        if by is None:
            by = np.lexsort((token, order, line))
        token, line, order = token[by], line[by], order[by]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        self.token, self.order, line = token[new], order[new], line[new]
        self.size = np.bincount(line, minlength=len(self.doc))
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        spread = textvec.mix(self.token)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread)))
        hashes = textvec.mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64))
        self.name = (np.minimum(self.size, MOST_WORDS).astype(np.uint64) << np.uint64(32) | hashes & LOW32).view(np.int64)
        self.maps = np.zeros((4, len(self.size)), np.uint64)
        some = np.flatnonzero(self.size)
        if len(some):
            bit, word = np.uint64(1) << (spread & np.uint64(63)), spread >> np.uint64(6) & np.uint64(3)
            for k in range(4):
                self.maps[k, some] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), self.first[some])
            small, middle = self.size <= MAP_WORDS[0], self.size <= MAP_WORDS[1]
            for k, into, on in ((2, 0, middle), (3, 1, middle), (1, 0, small)):  # narrower maps are wide ones folded
                self.maps[into] ^= np.where(on, self.maps[k], np.uint64(0))
                self.maps[k][on] = 0
            second = np.bitwise_xor.reduceat(np.uint64(1) << (spread >> np.uint64(8) & np.uint64(63)), self.first[some])
            self.maps[1, some] = np.where(small[some], second, self.maps[1, some])
            few = some[self.size[some] <= HASHED_WORDS]
            if len(few):
                at = np.cumsum(self.size[few]) - self.size[few]
                again = textvec.mix(self.token[textvec.ragged(self.first[few], self.size[few])] ^ np.uint64(0x9E3779B97F4A7C15))
                self.maps[2, few] = textvec.mix(np.add.reduceat(again, at))
        self.ident = identity(self.maps).view(np.int64)

    def compact(self) -> np.ndarray:
        """Tokens for comparisons: the rank of a ranked word stands for its hash, as it is shorter."""
        return np.where(self.order > 0, self.order, self.token.view(np.int64))

    def keys(self, lead: np.ndarray, share: Fraction, hot: int) -> tuple[np.ndarray, np.ndarray]:
        """(postings, line of each, in order of lines) of the lines' prefixes."""
        count = np.where(lead, _prefix(share, self.size), 0)
        at = textvec.ragged(self.first[:-1], count)
        line = np.repeat(np.arange(len(count)), count)
        single = self.order[at] < hot
        found = [(self.token[at[single]], (at - self.first[line])[single], line[single])]
        if not single.all():
            # a prefix is in order: its hot words stand at its end, and one word more is looked at
            many = np.bincount(line[~single], minlength=len(count))
            some = np.flatnonzero(many)
            begin, reach = self.first[some] + count[some] - many[some], np.minimum(self.first[some] + count[some], self.first[some + 1] - 1)
            gap = 1
            while len(some):
                n = np.minimum(many[some], np.maximum(reach - begin - gap + 1, 0))
                on = n > 0
                some, begin, reach, n = some[on], begin[on], reach[on], n[on]
                i, own = textvec.ragged(begin, n), np.repeat(some, n)
                found.append((textvec.mix(self.token[i] * np.uint64(3) ^ textvec.mix(self.token[i + gap])), i - self.first[own], own))
                gap += 1
        key, place, line = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(line, kind="stable")
        key, place, line = key[by], place[by], line[by]
        post = key & ~LOW32 | np.minimum(self.size[line], MOST_WORDS).astype(np.uint64) << np.uint64(PLACE_BITS) | np.minimum(place, MOST_PLACE).astype(np.uint64)
        return post.view(np.int64), line


def identity(maps: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """64 bits that follow from a set's maps: a hash of a small set, and of the others all that the first three maps know.

    Each step is one to one for given other maps, so sets that differ in one map only never share it.
    """
    out = maps[0] * np.uint64(0x9FB21C651E98DF25)
    for part in (maps[1], maps[2]):
        out ^= out >> np.uint64(32)
        out += part
        out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


def _prefix(share: Fraction, size: np.ndarray) -> np.ndarray:
    """Words of a line's prefix: n - ceil(t n) + 1; none for lines that only an equal one can match."""
    most = size * share.denominator // share.numerator
    alone = (most == size) & (-(-size * share.numerator // share.denominator) == size)
    # sizes that a posting has no room for: such lines go by equality alone
    return np.where(alone | (size >= MOST_WORDS * share.numerator // share.denominator), 0, size - (-(-size * share.numerator // share.denominator)) + 1)


def _least_overlap(share: Fraction, total: np.ndarray) -> np.ndarray:
    """Tokens that two lines of ``total`` tokens share at least: ceil(t total / (1 + t))."""
    ratio = share / (1 + share)
    return -(-total * ratio.numerator // ratio.denominator)


MAPS = ["map0", "map1", "map2", "map3"]
NAME = ["name", "ident"]


def map_distance(maps: list[np.ndarray], size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that differ between two lines' parity maps, at the width of the narrower one; of two maps the larger number."""
    a, b = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    apart = [m[i] ^ m[j] for m in maps]
    wide, half, small = a > MAP_WORDS[1], a > MAP_WORDS[0], b <= MAP_WORDS[0]
    count = lambda *x: sum(np.bitwise_count(v).astype(np.int64) for v in x)
    two = np.maximum(count(apart[0]), count(apart[1]))
    if small.all():
        return two
    folded = apart[0] ^ apart[2], apart[1] ^ apart[3]
    # between a small line and a larger one: the small one's first map is the other's, folded
    large = np.where(size[i] > MAP_WORDS[0], i, j)
    mixed = maps[0][np.where(size[i] > MAP_WORDS[0], j, i)]
    for m in maps:
        mixed = mixed ^ m[large]
    return np.where(small, two, np.where(wide, count(*apart), np.where(half, count(*folded), count(mixed))))


def _candidates(part: dict[str, np.ndarray], share: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs (later, earlier; differing bits) of whole keys, sorted by key and size, that pass all filters; ties both ways."""
    key, size, place, maps = part["key"], part["size"], part["place"], [part[c] for c in MAPS]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    group = np.searchsorted(edge, np.arange(len(key)), "right")
    # places are in order of (key, size): a row's partners end where the size grows over size / t
    width = int(size.max()) + 2
    rank = group * width + size
    end = np.searchsorted(rank, group * width + np.minimum(size * share.denominator // share.numerator, width - 1), "right")
    may = np.flatnonzero((place < size - _least_overlap(share, 2 * size) + 1) & (end > np.arange(len(key)) + 1))
    n = end[may] - may - 1
    out = []
    total = np.cumsum(n)
    a = 0
    while a < len(may):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK_PAIRS, "right")))
        i, j = np.repeat(may[a:b], n[a:b]), textvec.ragged(may[a:b] + 1, n[a:b])
        a = b
        least = _least_overlap(share, size[i] + size[j])
        fine = np.minimum(size[i] - place[i], size[j] - place[j]) >= least
        i, j, least = i[fine], j[fine], least[fine]
        apart = map_distance(maps, size, i, j)
        fine = apart <= size[i] + size[j] - 2 * least
        i, j, apart = i[fine], j[fine], apart[fine]
        after = lambda x, y: (part["doc"][x] > part["doc"][y]) | (part["doc"][x] == part["doc"][y]) & (part["number"][x] >= part["number"][y])
        for x, y in ((i, j), (j, i)):
            on = after(x, y)
            out.append((x[on], y[on], apart[on]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


PAIR = "name long, ident long, other long, other_ident long, doc long, other_doc long, apart int, tie boolean, several boolean"


def _meet(posts: DataFrame, share: Fraction, most: int | None) -> DataFrame:
    """Pairs of a line set (name, ident, doc) and an earlier one (other ...): of each key the ``most`` nearest; several: there are more.

    If ``posts`` has a column ``on``, only sets with it look for earlier ones.
    """
    some = "on" in posts.columns

    def look(table: pa.Table) -> pa.RecordBatch:
        part = {c: table[c].to_numpy() for c in table.column_names}
        post, who = part["post"], part["who"]
        part |= {c: part[c].view(np.uint64) for c in MAPS}
        part |= {"key": post >> 32, "size": post >> PLACE_BITS & MOST_WORDS, "place": post & MOST_PLACE, "number": who >> 32}
        part["name"] = part["size"] << 32 | who & 0xFFFFFFFF
        part["ident"] = identity([part[c] for c in MAPS]).view(np.int64)
        # by key and size, as the name's upper bits are the size
        by = np.lexsort((part["number"], part["doc"], part["ident"], post >> PLACE_BITS))
        part = {c: v[by] for c, v in part.items()}
        # a set's first occurrence stands for it; all occurrences have the same keys, so all are here
        new = np.ones(len(by), bool)
        new[1:] = np.any([part[c][1:] != part[c][:-1] for c in ("key", "name", "ident")], axis=0)
        part = {c: v[new] for c, v in part.items()}
        late, early, apart = _candidates(part, share)
        if some:
            on = part["on"][late]
            late, early, apart = late[on], early[on], apart[on]
        by = np.lexsort((part["number"][early], part["doc"][early], apart, late))
        late, early, apart = late[by], early[by], apart[by]
        turn = np.arange(len(late)) - np.searchsorted(late, late)
        several = np.bincount(late, minlength=len(part["key"]))[late] > (most or len(late))
        on = turn < (most or len(late) + 1)
        late, early, apart, several = late[on], early[on], apart[on], several[on]
        tie = (part["doc"][late] == part["doc"][early]) & (part["number"][late] == part["number"][early])
        ident = part["ident"]
        columns = (part["name"][late], ident[late], part["name"][early], ident[early], part["doc"][late], part["doc"][early], apart.astype(np.int32), tie, several)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], [x.split()[0] for x in PAIR.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textvec.keep_freed_memory()
        for table in textvec.whole_keys(batches, BLOCK_ROWS, lambda t: t["post"].to_numpy() >> 32):
            yield look(table)
        textvec.release()

    return posts.repartition(F.shiftright("post", 32)).sortWithinPartitions("post").mapInArrow(run, PAIR)


def _small(table: DataFrame) -> DataFrame:
    """A staged table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_SETS else table


def _compared(docs: DataFrame, pairs: DataFrame, ranked: Broadcast, share: Fraction) -> DataFrame:
    """The pairs whose whole token sets reach the threshold; ``docs`` has doc and text."""
    spark = docs.sparkSession
    both = pairs.select(*NAME, "doc").union(pairs.select("other", "other_ident", "other_doc"))
    wanted = staged(both.groupBy(*NAME).agg(F.min("doc").alias("doc")), "wanted")
    few = wanted.count() <= BROADCAST_SETS
    picked = None
    if few:  # only documents that hold a wanted set's first line go to Python
        picked = spark.sparkContext.broadcast(np.unique(wanted.select("name").toArrow()["name"].to_numpy()))
        docs = docs.join(F.broadcast(wanted.select("doc").distinct()), "doc", "left_semi")

    def among(names: np.ndarray, values: np.ndarray) -> np.ndarray:
        return names[np.minimum(np.searchsorted(names, values), len(names) - 1)] == values if len(names) else np.zeros(len(values), bool)

    def tokens(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets = LineSets(buf, offs, ranks_of(ranked))
        keep = np.flatnonzero(among(picked.value, sets.name) if picked is not None else sets.size > 0)
        keep = keep[np.unique(np.stack((sets.name[keep], sets.ident[keep])), axis=1, return_index=True)[1]]
        flat = sets.compact()[textvec.ragged(sets.first[keep], sets.size[keep])]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sets.size[keep]))), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(sets.name[keep]), pa.array(sets.ident[keep]), lists], [*NAME, "tokens"])

    whole = textvec.per_chunk(docs, tokens, "name long, ident long, tokens array<long>", ("text",)).groupBy(*NAME).agg(F.first("tokens").alias("tokens"))
    if not few:
        whole = whole.join(wanted, NAME, "left_semi")
    whole = staged(whole, "tokens")
    other = whole.select(F.col("name").alias("other"), F.col("ident").alias("other_ident"), F.col("tokens").alias("others"))
    both = pairs.select(*NAME, "other", "other_ident", "tie").join(whole, NAME).join(other, ["other", "other_ident"]).withColumn("same", F.size(F.array_intersect("tokens", "others")))
    close = both.filter(F.col("same") * (share.denominator + share.numerator) >= F.lit(share.numerator) * (F.size("tokens") + F.size("others")))
    return close.select(*NAME, "other", "other_ident", "tie")


_ranks: dict[str, Ranks] = {}


def ranks_of(ranked: Broadcast) -> Ranks:
    """The table of a broadcast list, made once a worker and list."""
    *table, name = ranked.value
    if name not in _ranks:
        _ranks.clear()
        _ranks[name] = Ranks(*table)
    return _ranks[name]


def text_key(text: Column | str = "text") -> Column:
    """What tells rows of one doc_id apart; equal rows have equal keys."""
    return F.xxhash64(text)


def repeated_lines(docs: DataFrame, threshold: Fraction | str = "0.8") -> DataFrame:
    """doc_id, text_key, line, n_tokens and ``gone`` of every non-blank line of ``docs(doc_id, text)``.

    ``gone``: an equal line (as a set of words) or a similar one comes earlier.  Lines
    are split at line feeds and numbered from 0; words are runs of non-blank
    characters, A-Z in lower case.  Earlier means a smaller doc_id, then a smaller
    ``text_key`` (a hash of the text), then a smaller line number; so rows that share
    a doc_id, or have none, are documents of their own, and wholly equal rows don't
    remove each other's lines.  doc_id is an integer; null ones come after all others.
    Null and empty texts and blank lines give no rows; an empty table gives none;
    other columns are ignored.
    """
    share = Fraction(threshold)
    ranked = frequent_words(docs)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_key().alias("text_key"), "text")

    def build(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(ranked)
        sets = LineSets(buf, offs, ranks)
        keep = np.flatnonzero(sets.size)
        ids, texts = rows.column(0).to_numpy()[sets.doc], rows.column(1).to_numpy()[sets.doc]
        # of equal lines in a chunk the first one stands for all: the others are gone, unless they have its very place (repeated rows)
        by = keep[np.lexsort((sets.number[keep], texts[keep], ids[keep], sets.ident[keep], sets.name[keep]))]
        new = np.ones(len(by), bool)
        new[1:] = (sets.name[by][1:] != sets.name[by][:-1]) | (sets.ident[by][1:] != sets.ident[by][:-1])
        first = by[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(by) else by
        lead, posting = np.zeros(len(sets.size), bool), np.zeros(len(sets.size), bool)
        lead[by] = (ids[by] == ids[first]) & (texts[by] == texts[first]) & (sets.number[by] == sets.number[first])
        posting[by[new]] = True
        post, line = sets.keys(posting, share, ranks.hot)
        ends = np.concatenate(([0], np.cumsum(np.bincount(line, minlength=len(sets.size))[keep])))
        columns = (ids[keep], texts[keep], sets.number[keep].astype(np.int32), sets.name[keep], np.where(lead, sets.ident, 0)[keep], *np.where(lead, sets.maps, 0)[:, keep].view(np.int64), sets.size[keep].astype(np.int32), lead[keep])
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(post))], ["doc", "text_key", "line", *NAME, *MAPS, "n_tokens", "lead", "posts"])

    table = staged(textvec.per_chunk(docs, build, "doc long, text_key long, line int, name long, ident long, map0 long, map1 long, map2 long, map3 long, n_tokens int, lead boolean, posts array<long>", ("doc", "text_key", "text")), "lines")
    leads = table.filter("lead").select("doc", "text_key", "line", *NAME, "n_tokens")
    holding = table.filter("size(posts) > 0")
    each = [F.explode("posts").alias("post"), F.expr("shiftleft(cast(line as long), 32) | (name & 4294967295L)").alias("who"), "doc", *MAPS]
    found = left = None
    for most in LOOKS:
        if left is None:
            pair, other = F.struct("apart", "other_doc", "other", "other_ident", "tie", "doc"), F.struct("other", "other_ident")
            met = _meet(holding.select(*each), share, most).groupBy(*NAME).agg(F.min(pair).alias("best"), (F.max("several") | (F.min(other) != F.max(other))).alias("several"))
            met = met.select(*NAME, "best.*", "several")
        else:
            open_ = _small(left.select(*NAME, F.lit(True).alias("on")))
            keys = holding.join(open_, NAME).select(F.explode(F.expr("transform(posts, x -> shiftright(x, 32))")).alias("__key"))
            keys = staged(keys.distinct(), "keys")
            near = holding.join(open_, NAME, "left").select(*each, F.coalesce("on", F.lit(False)).alias("on")).join(_small(keys), F.shiftright("post", 32) == F.col("__key"), "left_semi")
            met = _meet(near, share, most).groupBy(*NAME, "other", "other_ident").agg(F.min("doc").alias("doc"), F.min("other_doc").alias("other_doc"), F.max("tie").alias("tie"), F.max("several").alias("several"))
        pairs = staged(met, "pairs")
        close = _in_order(staged(_compared(docs, pairs, ranked, share), "close"), leads)
        found = staged(close if found is None else found.union(close).distinct(), "similar")
        left = staged(pairs.filter("several").select(*NAME).distinct().join(found, NAME, "left_anti"), "left")
        if not left.head(1):
            break
    here = F.struct("doc", "text_key", "line")
    # of a set's first lines in the chunks, all but the very first are gone, and that one if a similar line comes before
    first = F.min(here).over(Window.partitionBy(*NAME, "n_tokens"))
    known = _small(found.select(*NAME, F.lit(True).alias("similar")))
    lines = leads.withColumn("first", first).join(known, NAME, "left").select("doc", "text_key", "line", "n_tokens", (F.coalesce("similar", F.lit(False)) | (here > F.col("first"))).alias("gone"))
    lines = lines.unionByName(table.filter("not lead").select("doc", "text_key", "line", "n_tokens", F.lit(True).alias("gone")))
    return lines.select(F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "text_key", F.col("line").cast("long").alias("line"), F.col("n_tokens").cast("long").alias("n_tokens"), "gone")


def _in_order(close: DataFrame, leads: DataFrame) -> DataFrame:
    """Names of the sets of pairs whose ``other`` is the earlier one, also where document and line number are the same."""
    clear = close.filter(~F.col("tie")).select(*NAME)
    if close.filter("tie").head(1):  # rows that share a doc_id
        first = leads.groupBy(*NAME).agg(F.min(F.struct("doc", "text_key", "line")).alias("first"))
        tied = close.filter("tie").join(first, NAME).join(first.toDF("other", "other_ident", "other_first"), ["other", "other_ident"]).filter("other_first < first")
        clear = clear.union(tied.select(*NAME))
    return clear.distinct()


def digest(docs: DataFrame, threshold: Fraction | str = "0.8") -> DataFrame:
    """doc_id, n_lines, n_gone, gone_sha256 (the gone lines' numbers, comma-joined) of every row of ``docs``.

    Null, empty and blank texts have no lines; rows without lines are there, too.
    """
    found = repeated_lines(docs, threshold)
    gone = F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("line"))))
    per = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.countDistinct("line").alias("n"), gone.alias("gone"))
    rows = docs.select("doc_id", text_key().alias("text_key"))
    joined = rows.join(per, rows["doc_id"].cast("long").eqNullSafe(per["__id"]) & (rows["text_key"] == per["__key"]), "left")
    gone = F.coalesce("gone", F.array().cast("array<long>"))
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_gone"), F.sha2(F.array_join(gone.cast("array<string>"), ","), 256).alias("gone_sha256"))


def drop_repeated_lines(docs: DataFrame, threshold: Fraction | str = "0.8") -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``; a row all of whose non-blank lines go is dropped.

    All columns stay; rows without a repeated line, blank and null texts are as they were.
    Each row loses its own lines: rows of one doc_id, or without one, are told apart by their text.
    """
    found = repeated_lines(docs, threshold).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set(F.when(F.col("gone"), F.col("line").cast("int"))).alias("__gone"), F.count(F.when(~F.col("gone"), 1)).alias("__left"))
    found = found.filter(F.size("__gone") > 0)
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__id"]) & (text_key(docs["text"]) == found["__key"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept)
    return joined.filter("__left is null or __left > 0").withColumn("text", text).select(*(f"`{c}`" for c in docs.columns))
