"""N-gram Jaccard join: rare-first prefix filter, length, positional and suffix filters, one check per pair.

Sets are the distinct shingles of `words` lower-cased words, as 64-bit hashes (texts with fewer words:
the whole sequence as one shingle). Documents with equal sets are one class and are joined once.

Rare first: document frequencies of all shingles are counted over all documents (see exchange.py) and shingles are
ordered by (frequency, hash). Of a document's rarest ones, of which a linked document must have one, only those that
occur in another document are joined.

A shingle that many documents have in their prefix does not make all pairs of them:

1. in each round every shingle that still connects different components has one leader, and every document of another
   component is checked against the leaders it shares most shingles with: one at first, twice as many each round, when
   fewer documents are left. The first round's leader is the document with the fewest rarer shingles: of a group of
   copies the one with the fewest changes, which all that link to anything link to first. A few rounds join the near
   copies;
2. when a round finds no link, what is left is joined: each pair of documents in different components that share a
   prefix shingle, with the length, positional and suffix filters in the join's own condition.

The suffix filter is a lower bound of the difference of two sets: both are dealt to PARITY parts by hash, and where the
parts' sizes differ by an odd number there is a difference. Shingles that no other document has are left out of the
parts, since they are known to be in no overlap. The join's condition uses the parts folded to 512; the rows that are
left are filtered by all of them.

Components are exact: every pair that may link is either checked or already connected. The numbers of links are counted
after that, since every link lies within a component: a dense component's sets are compared block by block, as products
of matrices, a sparse one's by the same prefixes and filters.

Null and blank text has no shingles and no links, and is a component of its own. Repeated rows are one
class; a null doc_id takes part, but isn't the smallest of a component unless all are null. Very long texts are worked
on one at a time, whole: a task holds the shingles of one of them at least. Ties among leaders go to the smaller set,
then the first row. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, exchange
from .components import components

PARITY = 4096  # parts of the suffix filter, a power of two
FOLDED = 8  # 64-bit words of them in the join's condition
RUN = 2048  # texts whose parts are worked on at a time
FLUSH = 1 << 20  # shingles held by a task
ROUNDS = 6  # of leaders
FACTORS = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(64)]


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, ordered by row and hash."""
    h, rows, _, _ = common.word_hashes(data, offsets)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    out_h, out_r = [], []
    if len(h) >= words:
        own = rows[: len(h) - words + 1]
        s = np.zeros(len(own), np.uint64)
        for j in range(words):
            s += h[j : len(own) + j] * FACTORS[j]
        whole = own == rows[words - 1 :]
        out_h.append(common.mix(s[whole]))
        out_r.append(own[whole])
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        first = np.searchsorted(rows, short)
        s = n[short].astype(np.uint64)
        for j in range(words - 1):
            has = n[short] > j
            s[has] += h[first[has] + j] * FACTORS[j + words]
        out_h.append(common.mix(s))
        out_r.append(short)
    if not out_h:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes, owners = np.concatenate(out_h), np.concatenate(out_r)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return owners[keep], hashes[keep]


def _frequencies(source: DataFrame, words: int) -> str:
    """A side table of the shingles that occur in more than one document, with their document frequencies."""
    parts = exchange.ranges(source)

    def count(batches):
        held: list[np.ndarray] = []
        size, pid = 0, None

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield from exchange.send(pid, 1, keys, n, np.zeros(len(keys), bool), parts)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            now = batch.column(0)[0].as_py() >> 33
            if held and (pid != now or size > FLUSH):
                yield from flush()
                size = 0
            pid = now
            for part in common.slices(batch, "text"):
                _, hashes = shingles(*common.text_buffers(part.column(1)), words)
                held.append(hashes)
                size += len(hashes)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    replies = exchange.answers(source.select("row_id", "text").mapInArrow(common.tidy(count), exchange.BLOBS), parts)
    return common.side_table(replies.where("pid >= 0").select("pid", "level", "keys", "counts"), "frequencies", source)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


MARKS = ["known", *(f"s{j}" for j in range(FOLDED))]
SETS = f"row_id long, doc_id long, n long, sig1 long, sig2 long, prefix array<long>, places array<int>, parity array<long>, known long, {', '.join(f's{j} long' for j in range(FOLDED))}"


def parities(own: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Whether an odd number of a row's hashes falls in each of PARITY parts: PARITY / 64 words for each row."""
    out = np.zeros(rows * PARITY // 64, np.uint64)
    bits = own * PARITY + (common.mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(65 - PARITY.bit_length())).astype(np.int64)
    np.bitwise_xor.at(out, bits // 64, np.uint64(1) << (bits % 64).astype(np.uint64))
    return out.reshape(rows, -1)


def _prefixes(source: DataFrame, words: int, percent: int, path: str) -> DataFrame:
    """Per document: set size, signature, its rarest shingles, of which a linked document has one at least, and what
    the suffix filter needs: how many of its shingles another document has, and their parities."""
    names = ["row_id", "doc_id", "n", "sig1", "sig2", "prefix", "places", "parity", *MARKS]

    def rows(batches):
        pid = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if pid != batch.column(0)[0].as_py() >> 33:
                pid = batch.column(0)[0].as_py() >> 33
                keys, counts = exchange.load(common.load_side(path, pid), 1)
            for part in (run.slice(at, RUN) for run in common.slices(batch, "text") for at in range(0, run.num_rows, RUN)):
                own, hashes = shingles(*common.text_buffers(part.column(2)), words)
                n = np.bincount(own, minlength=part.num_rows)
                ends = np.cumsum(n)
                starts = ends - n
                mixed = common.mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64))) for x in (mixed, common.mix(mixed + np.uint64(0x1234567)))]
                sig = [common.signed(c[ends] - c[starts]) for c in sums]
                often = np.ones(len(hashes), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    often = np.where(keys[at] == hashes, counts[at], 1)
                order = np.lexsort((hashes, often, own))
                place = np.arange(len(own)) - starts[own]
                most = n - (-(-percent * n // 100)) + (n > 0)
                keep = (place < most[own]) & (often[order] > 1)
                bounds = np.concatenate(([0], np.cumsum(np.bincount(own[keep], minlength=part.num_rows))))
                shared = often > 1
                parity = parities(own[shared], hashes[shared], part.num_rows)
                folded = np.bitwise_xor.reduce(parity.reshape(part.num_rows, -1, FOLDED), axis=1)
                known = np.bincount(own[shared], minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(sig[0]), pa.array(sig[1])),
                        *(_lists(common.signed(hashes[order][keep]), bounds), _lists(place[keep].astype(np.int32), bounds)),
                        _lists(common.signed(parity.reshape(-1)), np.arange(part.num_rows + 1) * (PARITY // 64)),
                        *(pa.array(known), *(pa.array(common.signed(np.ascontiguousarray(folded[:, j]))) for j in range(FOLDED))),
                    ],
                    names=names,
                )

    return common.stage(source.mapInArrow(common.tidy(rows), SETS), "sets")


def _sets_of(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The whole sets (sorted hashes, binary) of the wanted rows; the text stays where it is scanned."""
    path = common.side_table(wanted, "wanted", source)

    def rows(batches):
        schema = pa.schema([("row_id", pa.int64()), ("hashes", pa.binary())])
        pid, want = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if pid != batch.column(0)[0].as_py() >> 33:
                pid = batch.column(0)[0].as_py() >> 33
                side = common.load_side(path, pid)
                want = np.empty(0, np.int64) if side is None else np.sort(side["row_id"].to_numpy())
            ids = batch.column(0).to_numpy()
            some = batch.filter(pa.array(np.isin(ids, want)))
            for part in common.slices(some, "text"):
                own, hashes = shingles(*common.text_buffers(part.column(2)), words)
                bounds = np.searchsorted(own, np.arange(part.num_rows + 1))
                sets = [hashes[bounds[i] : bounds[i + 1]].astype("<u8").tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], schema=schema)

    return common.stage(source.mapInArrow(common.tidy(rows), "row_id long, hashes binary"), "whole-sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by whole sets. A document with many partners is a skewed key of an equi-join, which is
    split at run time: its set is one row on the other side."""
    both = pairs
    for k in ("a", "b"):
        both = both.join(sets.select(F.col("row_id").alias(k), F.col("hashes").alias(f"set_{k}")), k)

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common_ = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)) if len(x) else 0
                keep[i] = bool(common_) and 100 * common_ >= percent * (len(x) + len(y) - common_)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return common.stage(both.select("a", "b", "set_a", "set_b").mapInArrow(common.tidy(check), "a long, b long"), "links")


def _may_link(x: str, y: str, percent: int):
    """Length, positional and suffix filters for two rows (x, y: their columns' qualifiers) of one shingle."""
    c = lambda q, name: F.col(f"{q}{name}")
    n1, n2 = c(x, "n"), c(y, "n")
    need = F.ceil((n1 + n2) * F.lit(percent) / F.lit(100 + percent))
    differ = sum((F.bit_count(c(x, s).bitwiseXOR(c(y, s))) for s in MARKS[1:]), F.lit(0))
    length = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    return length & (F.least(n1 - c(x, "place"), n2 - c(y, "place")) >= need) & (c(x, "known") + c(y, "known") - differ >= 2 * need)


def _suffix_filter(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose sets differ in too many of all parts."""
    own = sets.select("row_id", "n", "known", "parity")
    for k in ("a", "b"):
        pairs = pairs.join(own.select(F.col("row_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "known", "parity"))), k)
    differ = F.expr("aggregate(zip_with(parity_a, parity_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    most = F.col("known_a") + F.col("known_b") - differ  # twice the overlap, at most
    return pairs.where(most * (100 + percent) >= 2 * (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def _settle(rows: DataFrame) -> DataFrame:
    """Prefix shingles (token, row_id, n, place, component) that connect different components, with the token's largest
    one."""
    rows = rows.select("token", "row_id", "n", "place", *MARKS, "component")
    split = rows.groupBy("token", "component").count().groupBy("token").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("count", "component")).alias("major")).where("parts > 1")
    return common.stage(rows.join(split.select("token", "major"), "token"), "open-tokens")


def _merge(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the components that new links (a, b) make of their components."""
    of = rows.select("row_id", "component").distinct()
    ends = links
    for k in ("a", "b"):
        ends = ends.join(of.select(F.col("row_id").alias(k), F.col("component").alias(f"of_{k}")), k)
    new = components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    merged = rows.join(new.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    return merged.withColumn("component", F.coalesce("into", "component")).drop("into", "major")


def _pairs(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


MEMBERS = 512  # sets of a block
HELD = 1 << 18  # shingles of a block
COLUMNS = 4096  # shingles that are multiplied at a time
DENSE = 16  # a component is dense where a pair in so many shares a prefix shingle


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered left with those numbered right."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[token] > 1
    place = np.cumsum(often > 1) - 1
    token, own = place[token[shared]], np.repeat(np.arange(len(sets)), sizes)[shared]
    out = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(token, kind="stable")
    token, own = token[order], own[order]
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, (at, at + COLUMNS))
        has = np.zeros((len(sets), min(COLUMNS, int(token[-1]) + 1 - at)), np.float32)
        has[own[a:b], token[a:b] - at] = 1.0
        out += has[left] @ has[right].T
    return out


def _by_blocks(members: DataFrame, whole: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(class, links) of members (class, component, n, size), each set compared with all of its component: a component is
    dealt into blocks of about MEMBERS sets and HELD shingles, and a task compares two blocks at a time."""
    blocks = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(MEMBERS)), F.ceil(F.sum("n") / F.lit(HELD))).cast("int").alias("blocks"))
    placed = members.join(blocks, "component").withColumn("block", F.expr("cast(pmod(xxhash64(class), blocks) as int)"))
    each = placed.select("component", "class", "size", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    each = each.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "size")
    each = each.join(whole.select(F.col("row_id").alias("class"), "hashes"), "class").select("component", "i", "j", "block", "class", "size", "hashes")

    def count(rows):
        block, key, weight = (np.array([r[c] for r in rows], np.int64) for c in range(3))
        sets = [r[3] for r in rows]
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        n = np.array([len(x) for x in sets], np.int64)
        both = overlaps(sets, left, right)
        linked = (both > 0) & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both))
        linked &= left[:, None] != right[None, :]
        out = [(key[left], linked @ weight[right])]
        if block.min() != block.max():
            out.append((key[right], linked.T @ weight[left]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def links(batches):
        now, held = None, []
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def tell():
            keys, numbers = (np.concatenate(x) for x in zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(numbers.astype(np.int64))], names=["class", "links"])

        def settle():
            if (now[1] == now[2] or len({r[0] for r in held}) > 1) and len(held) > 1:
                done.append(count(held))

        for batch in batches:
            component, i, j, block, key, size = (batch.column(c).to_pylist() for c in range(6))
            for at, raw in enumerate(batch.column(6)):
                if (component[at], i[at], j[at]) != now:
                    if held:
                        settle()
                    now, held = (component[at], i[at], j[at]), []
                held.append((block[at], key[at], size[at], np.frombuffer(raw.as_buffer(), "<u8")))
            if len(done) > 1000:
                yield tell()
        if held:
            settle()
        if done:
            yield tell()

    dealt = each.repartition(tasks, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return common.stage(dealt.mapInArrow(common.tidy(links), "class long, links long"), "counted")


def _count_links(joined: DataFrame, classes: DataFrame, shared: DataFrame, ones: DataFrame, whole: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(class, links): how many documents of other classes link with a class. A link lies within a component. In a
    dense component all pairs are compared, in a sparse one those that share a prefix shingle and pass the filters."""
    sized = classes.select("class", "n", "size").join(joined.withColumnRenamed("node", "class"), "class")
    members = common.stage(sized.select("class", "component", "n", "size"), "members")
    rows = shared.join(members.select(F.col("class").alias("row_id"), "component"), "row_id")
    meet = rows.groupBy("component", "token").count().groupBy("component").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("meet"))
    kinds = members.groupBy("component").count().join(meet, "component", "left")
    kinds = common.stage(kinds.select("component", (F.coalesce("meet", F.lit(0)) * 2 * DENSE < F.col("count") * (F.col("count") - 1)).alias("sparse")), "kinds")
    links = _by_blocks(members.join(kinds.where("not sparse").select("component"), "component"), whole, percent, tasks)
    sparse = kinds.where("sparse").select("component")
    if sparse.limit(1).count():
        x = rows.join(sparse, "component")
        y = x.alias("y")
        meeting = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") == F.col("y.component")) & (F.col("x.row_id") < F.col("y.row_id"))
        pairs = x.alias("x").join(y, meeting & _may_link("x.", "y.", percent)).select(F.col("x.row_id").alias("a"), F.col("y.row_id").alias("b")).distinct()
        found = _verify(_suffix_filter(pairs, ones, percent), whole, percent)
        size = members.select("class", "size")
        ends = found.union(found.select("b", "a")).join(size.withColumnRenamed("class", "b"), "b")
        links = links.union(ends.select(F.col("a").alias("class"), F.col("size").alias("links")))
    return links.groupBy("class").agg(F.sum("links").alias("links"))


def similar(docs: DataFrame, words: int = 5, percent: int = 80, count: bool = True) -> DataFrame:
    """row_id, doc_id, n_shingles, class (first row of the equal sets), component (first row of it), n_links (other
    documents that it links with directly, copies included; without `count` null, for callers that need components
    alone)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source = common.with_row_id(docs, "doc_id", "text")
    sets = _prefixes(source, words, percent, _frequencies(source, words))
    classes = common.stage(sets.where("n > 0").groupBy("n", "sig1", "sig2").agg(F.min("row_id").alias("class"), F.count("*").alias("size")), "classes")
    ones = sets.join(classes.select(F.col("class").alias("row_id")), "row_id", "left_semi")
    shared = common.stage(ones.select("row_id", "n", *MARKS, F.explode(F.arrays_zip("prefix", "places")).alias("p")).select(F.col("p.prefix").alias("token"), "row_id", "n", F.col("p.places").alias("place"), *MARKS), "prefixes")

    links, done = None, None
    still = _settle(shared.withColumn("component", F.col("row_id")))
    whole = _sets_of(source, still.select("row_id").distinct(), words)
    for turn in range(ROUNDS):
        first = F.struct("place", "n", "row_id") if turn == 0 else F.struct(F.xxhash64("row_id", "token", F.lit(turn)), "row_id")
        lead = still.groupBy("token").agg(F.min_by(F.struct("row_id", "n", "place", "component", *MARKS), first).alias("lead"))
        led = still.join(lead, "token").where(F.col("component") != F.col("lead.component")).where(_may_link("", "lead.", percent))
        votes = led.select("row_id", F.col("lead.row_id").alias("leader")).repartition("row_id").groupBy("row_id", "leader").count()
        best = Window.partitionBy("row_id").orderBy(F.desc("count"), "leader")  # a row has as many as prefix shingles at most
        chosen = votes.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2**turn)
        pairs = chosen.select(*_pairs(F.col("row_id"), F.col("leader"))).distinct()
        pairs = common.stage(pairs.join(done, ["a", "b"], "left_anti") if done is not None else pairs, "led")
        found = _verify(pairs, whole, percent)
        done = pairs if done is None else done.union(pairs)
        if not found.limit(1).count():
            if turn:
                break
            continue
        links = found if links is None else common.stage(links.union(found), "links")
        still = _settle(_merge(still, found))

    x, y = still.where("component <> major").alias("x"), still.alias("y")
    across = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.row_id") < F.col("y.row_id")))
    may = _may_link("x.", "y.", percent)
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & across & may).select(*_pairs(F.col("x.row_id"), F.col("y.row_id"))).distinct()
    rest = common.stage(_suffix_filter(rest.join(done, ["a", "b"], "left_anti"), ones, percent), "rest")
    if rest.limit(1).count():
        found = _verify(rest, whole, percent)
        links = found if links is None else common.stage(links.union(found), "links")
    if links is None:
        links = rest.limit(0)
    joined = components(links)

    tasks = max(common.scan_partitions(source), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of_class = classes.join(joined.withColumnRenamed("node", "class"), "class", "left")
    if count:
        of_class = of_class.join(_count_links(joined, classes, shared, ones, whole, percent, tasks), "class", "left")
        number = F.col("size") - 1 + F.coalesce("links", F.lit(0))
    else:
        number = F.lit(None).cast("long")
    of_class = of_class.select("n", "sig1", "sig2", "class", F.coalesce("component", "class").alias("component"), number.alias("n_links"))
    rows = sets.select("row_id", "doc_id", "n", "sig1", "sig2").join(of_class, ["n", "sig1", "sig2"], "left")
    n_links = F.coalesce("n_links", F.lit(0)) if count else F.col("n_links")
    return rows.select("row_id", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "row_id").alias("class"), F.coalesce("component", "row_id").alias("component"), n_links.alias("n_links"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: 4-word shingles, Jaccard similarity of 0.85 or more; n_links (other
    documents it links with) and class_id (smallest doc_id of those with its shingles)."""
    rows = common.stage(similar(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85), "joined")
    names = rows.groupBy("component", "class").agg(F.min("doc_id").alias("class_id"))
    names = names.join(names.groupBy("component").agg(F.min("class_id").alias("component_id")), "component")
    return rows.join(names.drop("component"), "class").select("doc_id", "n_shingles", "component_id", "n_links", "class_id")
