"""Exact Jaccard join of documents by word shingles, with a token-group matrix.

1. Documents with equal shingle sets form a class; everything below is about classes.
2. Classes that share a least hash are compared with a few leaders: verified links merge most near copies.
3. Classes are partitioned into groups: linked ones by component; the others by the token that most classes share among
   their prefix tokens (the rarest tokens of a set, of which two linked sets share at least one), so that classes with a
   common passage stand together. Groups are cut into blocks of bounded size and of sets of about one size.
4. The token-group matrix holds, for each block, the union of its members' prefix tokens. A query class meets only the
   blocks whose row has one of its own prefix tokens and whose sizes fit, and the number of tokens met bounds its overlap
   with every member. Blocks that qualify are opened: the overlap with the union of their whole sets is bounded once
   more, then the overlaps with all members are counted at once over the block's tokens.
5. Links found there merge components. Pairs inside a component need no comparison, so no link between components is
   lost and a large group of copies is never expanded into pairs; a token that many classes share has a row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .graph import components
from .shared import WordHashes, delete, drop_stored, free_shuffles, lean, mix, new_path, small_or_shuffled, space_words, stored

WORDS = 5
#: Sets link from 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Least hashes of a set by as many orders; leaders a class is compared with at most in step 2.
KEYS, LEADERS = 2, 8
#: log2 of the bits that mark hashes of two or more classes; frequent tokens that are told apart.
MARK_BITS, FREQUENT = 26, 1 << 18
#: Classes with a prefix token that at least FAMILY classes share are grouped by it; classes and tokens of a block at most.
FAMILY, BLOCK, BLOCK_TOKENS = 16, 4096, 1 << 20
#: Sizes of the sets of a block differ by less than this factor.
BAND = 1.12
#: Bytes of text whose sets a worker holds at a time, and tokens whose frequencies it counts together.
GROUP, COUNTED = 4 << 20, 4_000_000
#: Classes with one least hash, and queries of one block, that go to one task together.
SPREAD = 2048

_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(words: list[bytes], hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``size`` consecutive words; of all words where there are fewer; empty without."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), 1 + len(words))], np.uint64)
    n = len(h) - size + 1
    total = h[:n] * _ODD[0]
    for j in range(1, size):
        total += h[j : j + n] * _ODD[j % len(_ODD)] + np.uint64(j)
    return np.unique(mix(total))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_key(tokens: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(tokens.tobytes()))


def packed(tokens: np.ndarray) -> bytes:
    """A set for the way to another task: the upper 48 bits of its sorted tokens, which tell the tokens of two sets apart."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def least_hashes(tokens: np.ndarray) -> list[int]:
    return [signed(int(mix(tokens ^ _ODD[j]).min())) for j in range(KEYS)]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n tokens shares at least with any set it links with."""
    return -(-percent * n // 100)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Row by row the set of the text, with its class key: (doc_id, key, tokens); in groups of some GROUP bytes of text."""
    hashes = WordHashes(most=300_000)
    group, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            tokens = shingles(space_words(raw, lower=True), hashes)
            group.append((doc_id, set_key(tokens) if len(tokens) else None, tokens))
            size += len(raw)
            if size > GROUP:
                yield group
                group, size = [], 0
    yield group


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each document, and one of each token (doc_id and n null) that is frequent among some COUNTED tokens of classes."""
    names = ["doc_id", "n", "sk", "keys", "token", "df"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def made(*columns) -> pa.RecordBatch:
        n = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def frequent(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, df = np.unique(np.concatenate(parts), return_counts=True)
        often = np.flatnonzero(df > 3)
        often = often[np.argsort(-df[often], kind="stable")[:20_000]]
        return made(None, None, None, None, tokens[often].view(np.int64), df[often])

    seen: set[int] = set()
    held, count = [], 0
    for rows in _sets(batches):
        if len(seen) > 500_000:
            seen.clear()
        yield made([d for d, _, _ in rows], [len(t) for _, _, t in rows], [k for _, k, _ in rows], [least_hashes(t) if len(t) else None for _, _, t in rows], None, None)
        new = [t for _, key, t in rows if len(t) and key not in seen and not seen.add(key)]
        held += new
        count += sum(map(len, new))
        if count > COUNTED:
            yield frequent(held)
            held, count = [], 0
    if held:
        yield frequent(held)


def _marked(keys: DataFrame) -> np.ndarray:
    """A bit array of fixed size with the bits of all given keys set (gathered as at most 2^(MARK_BITS-6) words)."""
    bit = F.col("key").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    words = keys.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _is_marked(marks: np.ndarray, key: int) -> bool:
    at = key & ((1 << MARK_BITS) - 1)
    return bool(int(marks[at >> 6]) >> (at & 63) & 1)


def _run_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each class with the leaders of its run (rows sorted by key, salt, sk); one row's sets are held at a time."""
    run, leaders, last = None, [], None
    for batch in batches:
        a, b = [], []
        keys, salts, sks, blobs = (batch.column(k) for k in range(4))
        for key, salt, sk, blob in zip(keys.to_pylist(), salts.to_pylist(), sks.to_pylist(), blobs.to_pylist(), strict=True):
            if (key, salt) != run:
                run, leaders, last = (key, salt), [], None
            if sk == last:
                continue
            last, tokens = sk, unpacked(blob)
            for leader, own in leaders:
                if linked(own, tokens):
                    a.append(leader)
                    b.append(sk)
                    break
            else:
                if len(leaders) < LEADERS:
                    leaders.append((sk, tokens))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Block:
    """The members of a block, with an index of their tokens."""

    def __init__(self, members: list[tuple[int, np.ndarray]], linked: bool):
        self.keys = np.array([sk for sk, _ in members], np.int64)
        self.sizes = np.array([len(t) for _, t in members], np.int64)
        tokens, owners = np.concatenate([t for _, t in members]), np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], owners[order]
        #: Members with one label are known to be connected.
        self.labels = np.zeros(len(members), np.int64) if linked else np.arange(len(members))

    def partners(self, sk: int, tokens: np.ndarray) -> list[int]:
        """One member of each label that the set links with; these labels become one."""
        first, last = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        held = last - first
        if int((held > 0).sum()) < least_overlap(len(tokens)):  # the union holds too few of its tokens
            return []
        first, held = first[held > 0], held[held > 0]
        at = np.repeat(first - np.cumsum(held) + held, held) + np.arange(held.sum())
        common = np.bincount(self.owners[at], minlength=len(self.keys))
        hit = np.flatnonzero((100 * common >= PERCENT * (len(tokens) + self.sizes - common)) & (self.keys != sk))
        if not len(hit):
            return []
        labels, one = np.unique(self.labels[hit], return_index=True)
        self.labels[np.isin(self.labels, labels)] = labels[0]
        return self.keys[hit[one]].tolist()


#: What a class that goes to a block is there (a sum): one of its members, a query, a member of a group that is connected already.
MEMBER, QUERY, LINKED = 1, 2, 4


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block (rows sorted: members, then mere queries), links of queries with members that connect all they link with."""
    run, members, asking, block, last = None, [], [], None, None
    a, b = [], []

    def ask(sk: int, tokens: np.ndarray) -> None:
        nonlocal block
        block = block or _Block(members, linked)
        found = block.partners(sk, tokens)
        a.extend(found)
        b.extend([sk] * len(found))

    def end() -> None:
        if len(members) > 1:
            for k in asking:
                ask(*members[k])

    def links() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a.clear()
        b.clear()
        return out

    linked = False
    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in range(6))
        for g, number, salt, kind, sk, blob in zip(*columns, strict=True):
            if (g, number, salt) != run:
                end()
                run, members, asking, block, last = (g, number, salt), [], [], None, None
            if (kind & MEMBER, sk) == last:
                continue
            last = kind & MEMBER, sk
            if kind & MEMBER:
                if kind & QUERY:
                    asking.append(len(members))
                members.append((sk, unpacked(blob)))
                linked = bool(kind & LINKED)
            elif members:
                ask(sk, unpacked(blob))
        yield links()
    end()
    yield links()


def classes_and_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, sk (class), comp (component's label) of every document row; sk and comp null without words."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    slim = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    profile_schema = "doc_id bigint, n bigint, sk bigint, keys array<bigint>, token bigint, df bigint"
    profiles = stored(slim.mapInArrow(lean(_profiles), profile_schema), "profiles")
    documents = profiles.where("n is not null").select("doc_id", "n", "sk", "keys")
    classes = documents.where("sk is not null").groupBy("sk").agg(F.min("n").alias("n"), F.min("keys").alias("keys"), F.min("doc_id").alias("rep"))

    frequent = profiles.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(FREQUENT).toArrow()
    tokens, df = frequent.column("token").to_numpy().view(np.uint64), frequent.column("df").to_numpy()
    by_token = np.argsort(tokens)
    shared_by = stored(
        classes.select("sk", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c"), F.min("sk").alias("leader")).where("c > 1"), "keys"
    )
    hot = shared_by.where(f"c > {2 * SPREAD}").select("key", F.ceil(F.col("c") / SPREAD).cast("int").alias("salts"), "leader")
    given = sc.broadcast((tokens[by_token], df[by_token], _marked(shared_by)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each class a row with its prefix (rarest tokens first; part 0), and, where it shares least hashes, one with these and its set (part 1)."""
        often, weight, marks = given.value
        seen: set[int] = set()
        for rows in _sets(batches):
            if len(seen) > 500_000:
                seen.clear()
            out = []
            for _, sk, t in rows:
                if not len(t) or sk in seen:
                    continue
                seen.add(sk)
                runs = [key for key in set(least_hashes(t)) if _is_marked(marks, key)]
                at = np.searchsorted(often, t)
                at[at == len(often)] = 0
                common = np.where(often[at] == t, weight[at], 0) if len(often) else np.zeros(len(t), np.int64)
                first = len(t) - least_overlap(len(t)) + 1
                prefix = t[np.argsort(common, kind="stable")[:first]]
                out.append((sk, len(t), prefix.view(np.int64), None, None, 0))
                if runs:
                    out.append((sk, None, None, runs, packed(t), 1))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["sk", "n", "prefix", "runs", "tokens", "part"])

    # one pass over the texts makes both parts; the sets, which are most of it, go as soon as the links are found
    emit_schema = "sk bigint, n bigint, prefix array<bigint>, runs array<bigint>, tokens binary, part int"
    path = new_path(spark, "prefixes")
    slim.mapInArrow(lean(emit), emit_schema).write.partitionBy("part").option("compression", "zstd").parquet(path)
    given.destroy()
    both = spark.read.schema(emit_schema).parquet(path)
    emitted, in_sets = both.where("part = 0"), both.where("part = 1")

    # a hash that many classes share is dealt out to several runs, each with the same leader
    in_runs = in_sets.select(F.explode("runs").alias("key"), "sk", "tokens").join(small_or_shuffled(hot), "key", "left")
    everywhere = F.when(F.col("sk") == F.col("leader"), F.sequence(F.lit(0), F.col("salts") - 1))
    one = F.array(F.coalesce(F.pmod("sk", "salts"), F.lit(0)).cast("int"))
    in_runs = in_runs.select("key", F.explode(F.coalesce(everywhere, one)).alias("salt"), "sk", "tokens")
    first_links = stored(in_runs.repartition("key", "salt").sortWithinPartitions("key", "salt", "sk").mapInArrow(lean(_run_links), "a bigint, b bigint"), "links")
    groups = components(first_links, "groups")

    delete(spark, f"{path}/part=1")
    free_shuffles(spark)
    # most prefix tokens stand in one class; those whose lower 32 bits do are left out before whole tokens are dealt out
    lower = emitted.select(F.explode("prefix").alias("token")).select(F.col("token").bitwiseAND(F.lit((1 << 32) - 1)).alias("key"))
    marked = sc.broadcast(_marked(lower.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")))

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The prefixes without the tokens whose bit is not set."""
        marks = marked.value
        for batch in batches:
            prefix = batch.column(2)
            flat = prefix.flatten().to_numpy(zero_copy_only=False)
            at = flat & ((1 << MARK_BITS) - 1)
            kept = (marks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            owner = np.repeat(np.arange(batch.num_rows), prefix.value_lengths().to_numpy(zero_copy_only=False))[kept]
            columns = [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(flat[kept], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["sk", "n", "token"])

    left = emitted.select("sk", "n", "prefix").mapInArrow(lean(promising), "sk bigint, n bigint, token bigint")
    placed = left.join(small_or_shuffled(groups), F.col("sk") == F.col("node"), "left").select("token", "sk", "n", "comp")
    # prefix tokens that stand in two or more components, and how many classes share each
    own = F.coalesce("comp", "sk")
    across = placed.groupBy("token").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.count("*").alias("df")).where("lo < hi")
    across = stored(across.select("token", "df"), "across")
    tokens_across = rows = stored(placed.join(across, "token").distinct(), "rows")
    marked.destroy()
    delete(spark, path)
    drop_stored(across, first_links, shared_by)
    # groups and blocks
    hottest = F.max(F.struct("df", "token")).over(Window.partitionBy("sk"))  # a class has a prefix's number of rows
    rows = rows.withColumn("m", hottest).withColumn("family", F.when(F.col("m.df") >= FAMILY, F.xxhash64("m.token")))
    rows = rows.select(
        "token", "sk", "n", F.coalesce("comp", "family", "sk").alias("g"), F.col("comp").isNotNull().alias("linked"),
        F.floor(F.log(F.col("n")) / np.log(BAND)).cast("int").alias("band"),
    )
    rows = stored(rows, "grouped")
    drop_stored(tokens_across)
    holds = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_TOKENS) / F.pow(F.lit(BAND), F.col("band") + 1))))
    cut = rows.select("g", "band", "sk").distinct().groupBy("g", "band").agg(F.ceil(F.count("*") / holds).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(small_or_shuffled(stored(cut, "cut")), ["g", "band"], "left")
    rows = rows.withColumn("block", F.expr("shiftleft(cast(band as bigint), 32) + coalesce(pmod(xxhash64(sk), blocks), 0)")).drop("band", "blocks")
    # the token-group matrix
    matrix = rows.groupBy("token", "g", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("members"))
    whole = Window.partitionBy("g", "block")  # a block has BLOCK_TOKENS rows at most
    matrix = matrix.withColumns({"least": F.min("least").over(whole), "most": F.max("most").over(whole)})
    matrix = matrix.select("token", "members", F.col("g").alias("to"), F.col("block").alias("to_block"), "least", "most")
    # each pair of blocks is met from one side; inside a block, a token must be that of another member
    before = (F.col("g") < F.col("to")) | ((F.col("g") == F.col("to")) & ~F.col("linked") & (F.col("block") < F.col("to_block")))
    inside = (F.col("g") == F.col("to")) & ~F.col("linked") & (F.col("block") == F.col("to_block")) & (F.col("members") > 1)
    fits = (100 * F.col("most") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("least"))
    met = rows.join(matrix, "token").where((before | inside) & fits)
    met = met.groupBy("to", "to_block", "sk").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n", "least", "most")])
    # Linked sets of n and m tokens share PERCENT * (n + m) / (100 + PERCENT) at least. Up to where the first of the two
    # prefixes ends, what they share is in both prefixes, so among the c tokens met; the rest is no longer than what
    # that set has after its prefix.
    smallest, largest = F.greatest("least", F.ceil(F.col("n") * PERCENT / 100)), F.least("most", F.floor(F.col("n") * 100 / PERCENT))
    shared = F.ceil(PERCENT * (F.col("n") + smallest) / (100 + PERCENT))
    after = F.greatest(F.ceil(F.col("n") * PERCENT / 100), F.ceil(largest * PERCENT / 100)) - 1
    meets = stored(met.where(F.col("c") >= shared - after).select(F.col("to").alias("g"), F.col("to_block").alias("block"), "sk"), "meets")

    salts = meets.groupBy("g", "block").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts"))
    members = rows.select("g", "block", "sk", (F.lit(MEMBER) + F.when(F.col("linked"), LINKED).otherwise(0)).alias("kind")).distinct().join(salts, ["g", "block"])
    members = members.select("g", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "sk", "kind")
    queries = meets.join(salts, ["g", "block"]).select("g", "block", F.expr("cast(pmod(xxhash64(sk, 7), salts) as int)").alias("salt"), "sk", F.lit(QUERY).alias("kind"))
    # a member that asks its own block goes there once
    open_rows = stored(members.unionByName(queries).groupBy("g", "block", "salt", "sk").agg(F.bit_or("kind").alias("kind")), "open")
    drop_stored(rows, meets)
    needed = stored(classes.join(open_rows.select("sk").distinct(), "sk", "left_semi").select("rep", "sk"), "needed")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _sets(batches):
            out = [(k, packed(t)) for _, k, t in out if len(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], names=["sk", "tokens"])

    wanted = needed.select(F.col("rep").alias("doc_id")).distinct()
    known = slim.join(small_or_shuffled(wanted), "doc_id", "left_semi")
    nameless = slim.where("doc_id is null")  # classes of nothing but rows without id
    sets = known.unionByName(nameless).mapInArrow(lean(gather), "sk bigint, tokens binary")
    opened = sets.join(small_or_shuffled(open_rows), "sk").select("g", "block", "salt", "kind", "sk", "tokens")
    opened = opened.repartition("g", "block", "salt").sortWithinPartitions("g", "block", "salt", F.col("kind").bitwiseAND(F.lit(MEMBER)).desc(), "sk")
    found = stored(opened.mapInArrow(lean(_opened), "a bigint, b bigint"), "opened")
    drop_stored(open_rows, needed)
    comp_of = {side: groups.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp")) for side in ("a", "b")}
    found = found.join(comp_of["a"], "a", "left").join(comp_of["b"], "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    merged = components(found, "merged").select(F.col("node").alias("comp"), F.col("comp").alias("final"))

    labels = groups.join(merged, "comp", "left").select("node", F.coalesce("final", "comp").alias("comp"))
    alone = merged.join(groups, merged["comp"] == groups["node"], "left_anti").select(F.col("comp").alias("node"), F.col("final").alias("comp"))
    labels = labels.unionByName(alone)
    return documents.join(labels, F.col("sk") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "sk", F.coalesce("comp", "sk").alias("comp")
    )


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Null and empty texts have no shingles and are components of their own. A null id takes its component's smallest
    id, null if none has one; repeated rows each get a row; rows that repeat an id with another text stay apart;
    other columns are not read; an empty table gives an empty result.
    """
    rows = stored(classes_and_components(docs, id_col, text_col), "components")
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(least, "comp", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id (null ids last). Rows without words all stay.

    Of rows that repeat both id and text one stays; the rows and columns that stay are as given.
    """
    text = docs[text_col].cast("string")
    words = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    rows = stored(classes_and_components(words).where("comp is not null"), "members")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "sk")).alias("m"))
    gone = rows.join(first, "comp").where("not (doc_id <=> m.doc_id and sk = m.sk)").select("doc_id", "sk").distinct()
    twice = rows.groupBy("doc_id", "sk").count().where("count > 1").select("doc_id", "sk")

    # rows are told apart by id and class; a class is made from the text once more, for rows whose id is concerned
    concerned = gone.select("doc_id").unionByName(twice.select("doc_id")).distinct()
    concerned = small_or_shuffled(stored(concerned, "concerned").select(F.col("doc_id").alias("_id")))
    same_id = docs[id_col].cast("bigint").eqNullSafe(concerned["_id"])
    untouched = docs.join(concerned, same_id, "left_anti").select(*[docs[c] for c in docs.columns])
    touched = docs.join(concerned, same_id, "left_semi").select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(most=300_000)
        for batch in batches:
            keys = []
            for x in batch.column(0).field(text_col).cast(pa.string()):  # a text at a time, as bytes
                tokens = shingles(space_words(x.as_buffer().to_pybytes() if x.is_valid else None, lower=True), hashes)
                keys.append(set_key(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["row", "doc_id", "sk"])

    touched = touched.select("row", F.col("row").getField(id_col).cast("bigint").alias("doc_id"))
    touched = touched.mapInArrow(lean(with_class), StructType([*touched.schema.fields, StructField("sk", LongType())]))
    out_of = small_or_shuffled(gone.select(F.col("doc_id").alias("_id"), F.col("sk").alias("_sk")))
    left = touched.join(out_of, touched["doc_id"].eqNullSafe(out_of["_id"]) & (touched["sk"] == out_of["_sk"]), "left_anti")
    again = left.where("sk is not null").dropDuplicates(["doc_id", "sk"]).unionByName(left.where("sk is null"))
    return untouched.unionByName(again.select("row.*"))
