"""N-gram Jaccard join by a token-group matrix, and the classes of texts that its links connect.

A text's set holds the hashes of its distinct five-word shingles (of the whole sequence, if it has fewer words); texts
with equal sets are one class and travel as one row. Two classes link when 100 * intersection >= 75 * union.

1. Order. Tokens that classes of one task share are counted; they come last in the order of tokens (by a bitmap of fixed
   size), the ``HOT`` most frequent of all at its end. Any order gives the same links, this one keeps common passages
   out of the prefixes.
2. Prefixes. Linked sets share a token among the first n - ceil(0.75 n) + 1 of each. Prefix tokens meet in one shuffle;
   a token of one class is dropped.
3. Leaders. A class is compared with the class that leads its longest list (the one with the fewest rare tokens), so
   a large group of near copies collapses by as many comparisons as it has members.
4. Token-group matrix. Classes go into groups, by the component of their leader; a group is cut into blocks of about
   ``BLOCK`` classes, and a block keeps the union of its members' tokens as a bitmap. A class is a query to the groups that
   share a prefix token with it, unless all of them are in its component already. The overlap of query and union bounds the
   overlap with each member; only blocks whose bound qualifies are opened, and there every member of another component is
   tested. Bitmaps only rule out; what they leave is tested on the tokens, which are read again for those classes alone.

All links between different components are found, so the components are exact; pairs inside a component need no test and
are never listed. Sets are 64-bit hashes, tests on them are exact.

Null and empty texts have no words: no set, no link, a component of their own. A null key is a row as any other and makes
no component smaller. Repeated rows fall into the same class. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.components import components
from quillgrid.llm.textbatch import NOT_SPACE, Words, bitmap_of, in_bitmap, mix, slices, text_of
from quillgrid.session import stored

SHINGLE = 5
#: Similarity in percent.
PERCENT = 75
HOT = 1 << 16
#: A task counts tokens over windows of so many, and reports those of so many classes.
WINDOW = 1 << 22
OFTEN = 2
COMMON_BITS = 26
BLOCK = 128
#: Sets that link differ in size by less than this factor.
SIZE_STEP = 1.34
_BITMAP_BITS = 22


def token_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct tokens of all rows in sequence, where each row's begin, and the class of each row.

    A class is a hash of a set; equal sets have equal classes. Rows without tokens have class 0 and no meaning.
    """
    h, row = Words(data, off, NOT_SPACE, lower=True).shingles(SHINGLE)
    edges = np.searchsorted(row, np.arange(len(off)))
    for a, b in zip(edges, edges[1:]):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    cut = np.searchsorted(row, np.arange(len(off)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h))])
    return h, cut, mix((total[cut[1:]] - total[cut[:-1]]) ^ np.diff(cut).astype(np.uint64)).view(np.int64)


def signature(tokens: np.ndarray) -> bytes:
    """A bitmap of a set, two bits or more for each token."""
    size = 64
    while size < 2 * len(tokens):
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def lacking(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many tokens of the set with bitmap a are not in the one with bitmap b."""
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, size), 0) if len(x) > size else x for x in (a, b))
    return int(np.bitwise_count(a & ~b).sum())


def may_link(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> bool:
    """Whether the bitmaps leave room for a link; never false for sets that link."""
    shared = min(size_a - lacking(a, b), size_b - lacking(b, a))
    return bool(linked(shared, size_a, size_b))


def prefix_size(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * shared >= PERCENT * (a + b - shared)


def _sets(plain: DataFrame) -> DataFrame:
    """A row per document (key, n, class, and once per task and class the signature), and rows of frequent tokens
    (token, classes) beside them."""
    kind = plain.schema["key"].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        waiting: list[np.ndarray] = []
        held, key_kind = 0, None

        def frequent():
            token, count = np.unique(np.concatenate(waiting), return_counts=True)
            often = count >= OFTEN
            none = [pa.nulls(int(often.sum()), t) for t in (key_kind, pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(token[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names)

        names = ["key", "n", "class", "signature", "token", "classes"]
        for s in slices(batches, "text"):
            key_kind = s.column("key").type
            tokens, cut, classes = token_sets(*text_of(s.column("text")))
            size, owner, signed = np.diff(cut), classes.tolist(), [None] * s.num_rows
            for i in np.flatnonzero(size).tolist():
                if owner[i] not in seen:
                    seen.add(owner[i])
                    x = tokens[cut[i] : cut[i + 1]]
                    signed[i] = signature(x)
                    waiting.append(x)
                    held += len(x)
            none = [pa.nulls(s.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([s.column("key"), pa.array(size.astype(np.int64)), pa.array(classes, mask=size == 0), pa.array(signed, pa.binary()), *none], names)
            if held >= WINDOW:
                yield frequent()
                waiting, held = [], 0
        if waiting:
            yield frequent()

    return stored(plain.mapInArrow(run, f"key {kind}, n bigint, class bigint, signature binary, token bigint, classes bigint"))


def _prefixes(plain: DataFrame, common: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Prefix tokens of every class, once per task: token, class, its rare tokens per mille, whether the token is hot."""
    shared = plain.sparkSession.sparkContext.broadcast((common, hot, rank))

    def run(batches):
        common, hot, rank = shared.value
        seen: set[int] = set()
        for s in slices(batches, "text"):
            tokens, cut, classes = token_sets(*text_of(s.column("text")))
            at = np.searchsorted(hot, tokens)
            at[at == len(hot)] = 0
            is_hot = hot[at] == tokens if len(hot) else np.zeros(len(tokens), bool)
            is_common = in_bitmap(common, tokens) | is_hot
            token, owner, rare, last = [], [], [], []
            for i in np.flatnonzero(np.diff(cut)).tolist():
                c = int(classes[i])
                if c in seen:
                    continue
                seen.add(c)
                a, b = cut[i], cut[i + 1]
                x, take, flags = tokens[a:b], prefix_size(int(b - a)), is_hot[a:b]
                usual, n_hot = ~is_common[a:b], int(flags.sum())
                if not usual.all():
                    # The order of all: rare tokens by hash, common ones by hash, hot ones by frequency.
                    frequent = x[flags][np.argsort(rank[at[a:b][flags]], kind="stable")]
                    x = np.concatenate([x[usual], x[~usual & ~flags], frequent])
                token.append(x[:take])
                owner.append(np.full(take, c, np.int64))
                rare.append(np.full(take, 1000 * int(usual.sum()) // len(x), np.int32))
                last.append(np.arange(take) >= len(x) - n_hot)
            if token:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(rare)), pa.array(np.concatenate(last))],
                    ["token", "class", "rare", "hot"],
                )

    return plain.mapInArrow(run, "token bigint, class bigint, rare int, hot boolean")


def _shared_tokens(prefixes: DataFrame) -> DataFrame:
    """Rows of tokens that two classes or more have, each class once.

    Hot tokens are known to be shared and spread by token and class. The others are sorted by token, and a pass over the
    sorted rows keeps those that have a neighbour of the same token.
    """

    def keep(batches):
        held, last = None, (None, None)  # a row whose token has had no neighbour yet; token and class of the last row
        for batch in batches:
            token, owner = batch.column("token").to_numpy(), batch.column("class").to_numpy()
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            if len(token) and (token[0], owner[0]) == last:
                fresh[0] = False
            index = np.flatnonzero(fresh)
            if not len(index):
                continue
            token = token[index]
            shared = np.zeros(len(token), bool)
            equal = token[1:] == token[:-1]
            shared[1:] |= equal
            shared[:-1] |= equal
            if token[0] == last[0]:
                shared[0] = True
                if held is not None:
                    yield held
            held = None if shared[-1] else batch.take(pa.array(index[-1:]))
            last = token[-1], owner[index[-1]]
            if shared.any():
                yield batch.take(pa.array(index[shared]))

    fields = "token bigint, class bigint, rare int"
    usual = prefixes.where("not hot").select("token", "class", "rare").repartition("token").sortWithinPartitions("token", "class").mapInArrow(keep, fields)
    hot = prefixes.where("hot").select("token", "class", "rare").dropDuplicates(["token", "class"])
    return stored(usual.unionByName(hot))


def _class_tokens(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """Class and sorted tokens of wanted classes, a row each; a bitmap of fixed size thins the texts before the join."""
    place = F.col("class").bitwiseAND((1 << _BITMAP_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(class & 63 as int))")
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (_BITMAP_BITS - 6), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = plain.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = shared.value
        seen: set[int] = set()
        for s in slices(batches, "text"):
            tokens, cut, classes = token_sets(*text_of(s.column("text")))
            wanted_bits = bits[(classes & ((1 << _BITMAP_BITS) - 1)) >> 6] >> (classes & 63) & 1
            owner, found = [], []
            for i in np.flatnonzero((np.diff(cut) > 0) & (wanted_bits == 1)).tolist():
                c = int(classes[i])
                if c not in seen:
                    seen.add(c)
                    owner.append(c)
                    found.append(tokens[cut[i] : cut[i + 1]].tobytes())
            if owner:
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(found, pa.binary())], ["class", "tokens"])

    found = plain.mapInArrow(run, "class bigint, tokens binary").join(wanted, "class", "left_semi")
    return stored(found.groupBy("class").agg(F.first("tokens").alias("value")).withColumn("n", (F.length("value") / 8).cast("bigint")))


def _paired(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The pairs (a, b) of classes whose rows of ``sets`` (class, value, n) pass a test."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("x", "nx", "y", "ny")]
            yield batch.select(["a", "b"]).filter(pa.array([bool(test(*row)) for row in zip(*columns)], pa.bool_()))

    left = sets.select(F.col("class").alias("a"), F.col("value").alias("x"), F.col("n").alias("nx"))
    right = sets.select(F.col("class").alias("b"), F.col("value").alias("y"), F.col("n").alias("ny"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "nx", "y", "ny").mapInArrow(run, "a bigint, b bigint")


def _signatures_allow(x: bytes, nx: int, y: bytes, ny: int) -> bool:
    return may_link(np.frombuffer(x, np.uint8), nx, np.frombuffer(y, np.uint8), ny)


def _sets_link(x: bytes, nx: int, y: bytes, ny: int) -> bool:
    both = np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)
    return linked(len(both), nx, ny)


def _by_block(batches, columns: list[str]):
    """Members (lists, once) and queries of every block in rows sorted by group, block and role; both as tuples."""
    key, members = None, []
    for batch in batches:
        for g, block, query, *row in zip(*[batch.column(c).to_pylist() for c in ("grp", "block", "query", *columns)]):
            if key != (g, block):
                key, members = (g, block), []
            if query:
                yield key, members, row
            else:
                members.append(row)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "query")


def _qualified(rows: DataFrame) -> DataFrame:
    """Queries (grp, block, class) that a block must be opened for.

    The union of the members' bitmaps bounds the overlap of a query with all of them; where it leaves room, the bitmap of
    some member of another component must leave room as well.
    """

    def run(batches):
        last, found = None, []
        for key, members, (c, component, n, raw) in _by_block(batches, ["class", "component", "n", "value"]):
            if key != last:
                last, maps = key, [np.frombuffer(m[3], np.uint8) for m in members]
                size = max(map(len, maps), default=8)
                union = np.bitwise_or.reduce([np.tile(m, size // len(m)) for m in maps]) if maps else None
            own = np.frombuffer(raw, np.uint8)
            if union is None or 100 * (n - lacking(own, union)) < PERCENT * n:
                continue
            if any(m[1] != component and may_link(own, n, x, m[2]) for m, x in zip(members, maps)):
                found.append((*key, c))
            if len(found) >= 10_000:
                yield packed(found)
                found = []
        yield packed(found)

    def packed(found):
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64()))], ["grp", "block", "class"])

    return _dealt(rows).mapInArrow(run, "grp bigint, block bigint, class bigint")


def _open_blocks(rows: DataFrame) -> DataFrame:
    """Links (a, b) between a query and members of other components, one per component."""

    def run(batches):
        last, a, b = None, [], []
        for key, members, (c, component, raw) in _by_block(batches, ["class", "component", "value"]):
            if key != last:
                last = key
                sets = [np.frombuffer(m[2], np.uint64) for m in members]
                sizes = np.array([len(x) for x in sets])
                flat, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
                places = np.array([m[1] for m in members])
            tokens = np.frombuffer(raw, np.uint64)
            at = np.searchsorted(tokens, flat)
            at[at == len(tokens)] = 0
            both = np.bincount(owner[tokens[at] == flat], minlength=len(members))
            hits = np.flatnonzero(linked(both, sizes, len(tokens)) & (places != component)) if len(members) else []
            for i in {int(places[i]): int(i) for i in hits}.values():
                a.append(c)
                b.append(members[i][0])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _dealt(rows).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles and component_id, the smallest key reachable by links."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = _sets(plain)
    rows = found.where("n is not null").select("key", "n", "class")
    signed = found.where("signature is not null").groupBy("class").agg(F.first("signature").alias("value"), F.first("n").alias("n"))
    # At most HOT rows reach the driver, whatever the size of the data.
    counted = stored(found.where("token is not null").groupBy("token").agg(F.sum("classes").alias("classes")))
    hot = counted.orderBy(F.desc("classes"), "token").limit(HOT).toArrow()
    token = hot["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    lists = _shared_tokens(_prefixes(plain, bitmap_of(counted, "token", COMMON_BITS), token[order], hot["classes"].to_numpy()[order]))

    # Leaders, and the star of every leader.
    leads = lists.groupBy("token").agg(F.count("*").alias("length"), F.min(F.struct("rare", "class"))["class"].alias("leader"))
    longest = lists.join(leads, "token").groupBy("class").agg(F.max(F.struct("length", "token", "leader"))["leader"].alias("leader"))
    longest = stored(longest)
    signed = stored(signed.join(longest.select("class"), "class", "left_semi"))
    star = _paired(longest.where("class <> leader").select(F.col("class").alias("a"), F.col("leader").alias("b")), signed, _signatures_allow)
    star = stored(star)
    ends = star.select(F.col("a").alias("class")).union(star.select("b")).distinct()
    star = stored(_paired(star, _class_tokens(plain, ends), _sets_link))
    first = components(star)

    # Groups, and the queries to them.
    with_component = lambda df, c, name: df.join(first.select(F.col("node").alias(c), F.col("component").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    classes = with_component(with_component(longest, "class", "component"), "leader", "grp").join(signed.select("class", "n"), "class")
    band = F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int")
    classes = stored(classes.select("class", "component", "grp", band.alias("band")))
    groups = classes.groupBy("grp", "band").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    listed = lists.select("token", "class").join(classes, "class")
    main = leads.select("token", F.col("leader").alias("class")).join(classes.select("class", F.col("component").alias("main")), "class").select("token", "main")
    mixed = listed.groupBy("token").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").join(main, "token").select("token", "main")
    listed = stored(listed.join(mixed, "token"))
    asks = listed.where("component <> main").select("token", F.col("class").alias("asker"), F.col("component").alias("own"), F.col("band").alias("asked"))
    offers = listed.select("token", "grp", "band").distinct()
    wanted = asks.join(offers, "token").where("abs(asked - band) <= 1").select("asker", "own", "grp", "band").distinct().join(groups, ["grp", "band"])
    wanted = stored(wanted.where("not (low = high and low = own)").select("asker", "own", "grp", "band", "members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("bigint")
    block = lambda number: (F.shiftleft(F.col("band").cast("bigint"), 40) + number).alias("block")
    opened = groups.join(wanted.select("grp", "band").distinct(), ["grp", "band"], "left_semi").select("grp", "band", "members")
    members = classes.join(opened, ["grp", "band"]).select("grp", block(F.pmod(F.xxhash64("class"), blocks)), F.lit(False).alias("query"), "class", "component")
    queries = wanted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("number"))
    queries = queries.select("grp", block(F.col("number")), F.lit(True).alias("query"), F.col("asker").alias("class"), F.col("own").alias("component"))
    qualified = stored(_qualified(members.unionByName(queries).join(signed, "class")))
    members = members.join(qualified.select("grp", "block").distinct(), ["grp", "block"], "left_semi")
    queries = queries.join(qualified, ["grp", "block", "class"], "left_semi")
    tested = stored(members.unionByName(queries))
    opens = stored(_open_blocks(tested.join(_class_tokens(plain, tested.select("class").distinct()), "class")))

    links = star.unionByName(opens)
    joined = components(links).withColumnRenamed("node", "class")
    smallest = rows.where("class is not null").groupBy("class").agg(F.min("key").alias("least"))
    smallest = smallest.join(joined, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    least = smallest.groupBy("component").agg(F.min("least").alias("component_id"))
    named = smallest.join(least, "component").select("class", "component_id")
    whole = rows.join(named, "class", "left")
    return whole.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
