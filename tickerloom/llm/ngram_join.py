"""All links between texts whose word-shingle sets are alike, by prefixes of token combinations.

Two sets link when 100 * |intersection| >= percent * |union|. For a set of n tokens a partner must hold at least
``least(n) = ceil(n * percent / 100)`` of them, so among any n - least(n) + e of its tokens the partner has e or more: with
tokens in one order that all texts share, two linked texts share e tokens of their prefixes of that length.

1. One pass over the texts: each set's size, a hash of it (equal sets become one node), and the prefix by hash order,
   extended by a tenth of the set.
2. Tokens of the prefixes are counted over all texts (each task first counts its own, so a token of a third of all texts is
   one entry a task). A text with fewer shared tokens than any partner would need has no partner and is done.
3. Only for the others all tokens are counted, and ordered by how often they occur. Tokens of one text drop out.
4. Prefixes in this order are indexed. Rare tokens are keys by themselves. Where a prefix reaches frequent tokens it is
   extended by one, as partners that share no rare token must then share two frequent ones: pairs of those are keys.
   (Texts of more than ``PAIR_SIZE`` shingles take single tokens there, and those near that size take both.) Keys also
   hold the size class; two sets that can link have one in common.
5. Texts that share a key are candidates, unless their sizes and bitmaps of their tokens (which bound what they share) rule a link out;
   a key gives out a star of those it joins. Texts that candidate pairs join, over any number of steps, form a cluster. Clusters
   are verified exactly, a batch of small ones or a pair of blocks of a large one in a task, which gives out the links of a
   spanning forest, never all pairs.
6. Components of those links, with the copies of each node, give every document its component.

Intersections are taken on 64-bit hashes of shingles.

Cases: null texts and texts without words have no shingles and are linked with nothing; a text with fewer words than a shingle
is one shingle; repeated rows are copies of each other; null ids never name a component that has another id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickerloom.llm import bloom
from tickerloom.llm.components import components
from tickerloom.llm.simhash import united
from tickerloom.llm.words import mixed, rounds, shingle_sets
from tickerloom.llm.work import discard, lean, packed, scratch, stage
from tickerloom.session import staged

#: Texts that a token may lie in to be a key by itself.
RARE = 32
#: Shingles up to which frequent tokens are paired.
PAIR_SIZE = 512
#: Texts and tokens that one side of a verifying task holds about.
BLOCK_TEXTS, BLOCK_TOKENS = 500, 1_000_000
#: Tokens that are counted together in one task.
CHUNK_TOKENS, BUCKET_TOKENS = 500_000, 1_000_000
#: Bits of a set's map, pairs of maps compared in one step, and nodes of a key up to which its pairs are compared.
MAP_BITS, MAP_PAIRS, KEY_TEXTS = 1024, 100_000, 256
#: Rows of keys that one task compares about, and groups of keys at least.
GROUP_ROWS, LEAST_GROUPS = 50_000, 64
_BITS = 40
_PLACE = np.uint64(24)
_SHARED = -1  # stands for "several texts of this task" where a node is given


def least_shared(n, percent: int):
    """Tokens that a partner of a set of n must share with it."""
    return -(-n * percent // 100)


def extension(n):
    return np.maximum(1, n // 10)


def node_of(tokens: np.ndarray) -> int:
    """One number for a set of tokens."""
    whole = np.bitwise_xor.reduce(mixed(tokens + np.uint64(0x51ED270B))) + np.uint64(len(tokens))
    number = int(mixed(np.array([whole], dtype=np.uint64)).view(np.int64)[0])
    return number if number != _SHARED else number - 1


def _short(tokens: np.ndarray) -> bytes:
    """Five bytes for each token, in an order that does not show the token's own."""
    part = (tokens >> np.uint64(64 - _BITS)) * np.uint64(0x9E3779B1) & np.uint64((1 << _BITS) - 1)
    return part.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def signed(docs: DataFrame, text: str, row_id: str, words: int, percent: int) -> DataFrame:
    """Per row: its id, _text (hash of the text), node (null without shingles), n, and the extended prefix."""
    rows = docs.select(row_id, F.xxhash64(F.col(text)).alias("_text"), F.col(text).cast("binary").alias("_raw"))
    schema = T.StructType([rows.schema[row_id], rows.schema["_text"]] + T._parse_datatype_string(
        "node bigint, n bigint, prefix binary").fields)

    def sign(frames):
        for frame in frames:
            out = []
            for tokens in shingle_sets(frame["_raw"].tolist(), words):
                n = len(tokens)
                size = min(n, int(n - least_shared(n, percent) + extension(n)))
                out.append((node_of(tokens) if n else None, n, _short(tokens[:size])))
            own = pd.DataFrame(out, columns=["node", "n", "prefix"], index=frame.index)
            yield frame[[row_id, "_text"]].join(own.astype({"node": "Int64"}))

    return rows.mapInPandas(lean(sign), schema)


def _counted_in_task(nodes: np.ndarray, prefixes: list[bytes], bits: int) -> pd.DataFrame:
    """Entries by bucket of tokens: one for each token of one text, one for all texts of a token of several.

    The latter texts are credited here: rows with counts hold the nodes and how many of their tokens others share.
    """
    nodes, first = np.unique(nodes, return_index=True)
    sizes = np.array([len(prefixes[i]) // 5 for i in first])
    tokens = _long(b"".join(prefixes[i] for i in first))
    packed = np.sort(tokens << _PLACE | np.repeat(np.arange(len(nodes), dtype=np.uint64), sizes))
    tokens, place = packed >> _PLACE, (packed & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    begins = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[begins, len(tokens)])
    own = nodes[place[begins]]
    own[runs > 1] = _SHARED
    credit = np.bincount(place[np.repeat(runs > 1, runs)], minlength=len(nodes))
    tokens = tokens[begins]
    cuts = np.searchsorted(tokens, np.arange(1 << bits, dtype=np.uint64) << np.uint64(_BITS - bits))
    out, cuts = [], [*cuts, len(tokens)]
    low = (tokens & np.uint64((1 << (_BITS - bits)) - 1)).astype(np.uint32)
    for bucket in range(1 << bits):
        a, b = cuts[bucket], cuts[bucket + 1]
        if a < b:
            out.append((bucket, low[a:b].tobytes(), own[a:b].tobytes(), None))
    held = np.flatnonzero(credit)
    for bucket in np.unique(nodes[held] & ((1 << bits) - 1)):
        mine = held[(nodes[held] & ((1 << bits) - 1)) == bucket]
        out.append((int(bucket), None, nodes[mine].tobytes(), credit[mine].astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "tokens", "nodes", "counts"])


def _counted_in_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    """(node, shared): how many of a node's tokens in this bucket other texts have too."""
    entries = frame[frame["tokens"].notna()]
    tokens = np.frombuffer(b"".join(entries["tokens"]), dtype=np.uint32)
    nodes = np.frombuffer(b"".join(entries["nodes"]), dtype=np.int64)
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])] if len(tokens) else np.zeros(0, bool)
    tokens, nodes = tokens[fresh], nodes[fresh]  # copies in several tasks are one node
    begins = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[begins, len(tokens)])
    several = np.repeat((runs > 1) | (nodes[begins] == _SHARED), runs)
    shared = nodes[several & (nodes != _SHARED)]
    credits = frame[frame["tokens"].isna()]
    every = np.r_[shared, np.frombuffer(b"".join(credits["nodes"]), dtype=np.int64)]
    counts = np.r_[np.ones(len(shared), np.int64), np.frombuffer(b"".join(credits["counts"]), dtype=np.int32)]
    distinct, place = np.unique(every, return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
    return pd.DataFrame({"node": distinct, "shared": total})


def possible(rows: DataFrame, percent: int) -> DataFrame:
    """node, n, and the least (id, _text) of the nodes that share enough prefix tokens with others to have a partner."""
    row_id = rows.columns[0]
    of_prefixes = rows.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    bits = min(20, max(8, math.ceil(math.log2(max(1, of_prefixes / 5 / BUCKET_TOKENS)))))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, prefixes, held = [], [], 0
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                nodes.append(part["node"].to_numpy(np.int64))
                prefixes += part["prefix"].tolist()
                held += part["prefix"].map(len).sum() // 5
                if held >= CHUNK_TOKENS:
                    yield _counted_in_task(np.concatenate(nodes), prefixes, bits)
                    nodes, prefixes, held = [], [], 0
        if nodes:
            yield _counted_in_task(np.concatenate(nodes), prefixes, bits)

    given = rows.filter("node IS NOT NULL")
    entries = given.select("node", "prefix").mapInPandas(lean(counted), "bucket int, tokens binary, nodes binary, counts binary")
    shared = entries.groupBy("bucket").applyInPandas(_counted_in_bucket, "node bigint, shared bigint")
    total = shared.groupBy("node").agg(F.sum("shared").alias("shared"))
    least = F.expr(f"(n * {percent} + 99) div 100")
    needed = F.greatest(F.lit(1), F.least(F.expr("n div 10"), F.expr("_least div 10")))
    nodes = given.groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct(F.col(row_id).alias("id"), "_text")).alias("first"))
    return (nodes.withColumn("_least", least).join(total, "node").filter(F.col("shared") >= needed)
            .select("node", "n", "first.id", "first._text"))


def _same_row(row_id: Column, text: Column) -> Column:
    return row_id.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))


def shared_sets(
    docs: DataFrame, able: DataFrame, text: str, row_id: str, words: int, repeats: bool
) -> tuple[DataFrame, list[str]]:
    """node, n, and the tokens that other nodes of ``able`` have too, with their numbers of texts, the rarest first.

    ``repeats`` tells that fully equal rows may occur.
    """
    wanted = able.select(F.col("id").alias("_id"), F.col("_text").alias("_hash"), "node", "n")
    raw = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"),
                      F.xxhash64(F.col(row_id), F.xxhash64(F.col(text))).alias("_key"))
    # A filter of the wanted rows turns most texts away before the join moves them.
    held = bloom.filled(able.select(F.xxhash64("id", "_text").alias("_key")), able.count())
    # Texts are cut behind an exchange (merge), so no task needs a Python worker for the filter and one for the cut.
    found = bloom.passing(raw, held).join(wanted.hint("merge"), _same_row(F.col("id"), F.col("text"))).select(
        "node", "n", F.col("text").cast("binary").alias("raw"))

    def cut(frames):
        for frame in frames:
            raw = frame["raw"].tolist()
            for lo, hi in rounds(raw):
                sets = [s.view(np.int64) for s in shingle_sets(raw[lo:hi], words)]
                yield frame.iloc[lo:hi][["node", "n"]].assign(tokens=sets)

    # Fully equal rows give a node twice.
    once = found.dropDuplicates(["node"]) if repeats else found
    sets, path = stage(once.mapInPandas(lean(cut), "node bigint, n bigint, tokens array<bigint>"), "token-sets")
    # Dealt out by token once: the counts and the join with them read the same exchange (a token has one row a text at most,
    # a small part of all rows even if every text has it).
    each = sets.filter("node IS NOT NULL").select("node", F.explode("tokens").alias("token")).repartition("token")
    often = each.groupBy("token").agg(F.count("node").cast("int").alias("texts")).filter("texts > 1")
    kept = each.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("texts", "token"))).alias("own"))
    out, at = stage(kept.join(sets.select("node", "n"), "node").select(
        "node", "n", F.col("own.token").alias("tokens"), F.col("own.texts").alias("texts")), "shared-tokens")
    return out, [path, at]


def keys_of(n: int, tokens: np.ndarray, texts: np.ndarray, percent: int) -> np.ndarray:
    """The keys under which a set is indexed; ``tokens`` are those that others share, the rarest first."""
    first = n - int(least_shared(n, percent)) + 1 - (n - len(tokens))  # entries of the prefix that others share
    if first <= 0:
        return tokens[:0]
    prefix = tokens[:first]
    rare = texts[:first] <= RARE
    keys = [mixed(prefix[rare] + np.uint64(1))]
    if not rare.all():
        if n > PAIR_SIZE * percent // 100:
            keys.append(mixed(prefix[~rare] + np.uint64(2)))
        if n <= PAIR_SIZE:
            often = tokens[: first + 1][texts[: first + 1] > RARE]
            a, b = np.triu_indices(len(often), 1)
            keys.append(mixed(mixed(often[a] + np.uint64(3)) + often[b]))
    out = np.concatenate(keys)
    # Sizes of two linked sets differ by a factor of less than 1.01 * 100 / percent: classes a and a + 1 meet.
    level = int(math.log(n) / math.log(101 / percent))
    return np.concatenate([mixed(out ^ np.uint64(level)), mixed(out ^ np.uint64(level + 1))])


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each of MAP_BITS shares of all tokens: set if the set holds some of the share."""
    bits = np.zeros(MAP_BITS, dtype=np.uint8)
    bits[mixed(tokens.view(np.uint64) + np.uint64(4)) % np.uint64(MAP_BITS)] = 1
    return np.packbits(bits).tobytes()


def _may_link(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): links that join the nodes of each key as all pairs would that may be linked by size and bitmaps.

    Sets differ by one token at least for each bit in which their bitmaps do, which bounds what they share.
    """
    frame = frame.sort_values("key", kind="stable")
    nodes, first, place = np.unique(frame["node"].to_numpy(np.int64), return_index=True, return_inverse=True)
    own = frame.iloc[first]
    bits = np.frombuffer(b"".join(own["bits"]), dtype=np.uint64).reshape(len(nodes), -1)
    n, held = own["n"].to_numpy(np.int64), own["held"].to_numpy(np.int64)
    keys = frame["key"].to_numpy(np.int64)
    span = np.searchsorted(keys, keys, "right") - np.arange(len(keys)) - 1
    label = np.arange(len(nodes))
    todo = np.flatnonzero(span)
    total, start = np.cumsum(span[todo]), 0
    while start < len(todo):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + MAP_PAIRS, "right")))
        rows, count = todo[start:end], span[todo[start:end]]
        other = np.repeat(rows + 1 - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        a, b = place[np.repeat(rows, count)], place[other]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        shared = (held[a] + held[b] - differ) // 2
        near = 100 * shared >= percent * (n[a] + n[b] - shared)
        label = united(label, a[near], b[near])
        start = end
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[away], "b": nodes[label[away]]})


def clusters(sets: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """(node, root) of nodes that candidate pairs join, over any number of steps.

    Nodes that share a key are a candidate pair if their bitmaps do not rule a link out; those of a key with very many nodes are all
    taken for candidates.
    """

    def index(frames):
        for frame in frames:
            keys = [keys_of(int(n), np.asarray(t, dtype=np.int64).view(np.uint64), np.asarray(c), percent).view(np.int64)
                    for n, t, c in zip(frame["n"], frame["tokens"], frame["texts"], strict=True)]
            yield pd.DataFrame({"node": frame["node"], "keys": keys})

    def mapped(frames):
        for frame in frames:
            tokens = [np.asarray(t, dtype=np.int64) for t in frame["tokens"]]
            yield frame[["node", "n"]].assign(held=[len(t) for t in tokens], bits=[bitmap(t) for t in tokens])

    rows = sets.mapInPandas(lean(index), "node bigint, keys array<bigint>").select("node", F.explode("keys").alias("key"))
    keyed, path = stage(rows, "keys")
    least, at = stage(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("texts"))
                      .filter("texts > 1").select("key", "pivot", "texts"), "pivots")
    held, crowded = least.agg(F.sum(F.when(F.col("texts") <= KEY_TEXTS, F.col("texts"))), F.max("texts")).first()
    maps = sets.mapInPandas(lean(mapped), "node bigint, n bigint, held int, bits binary")
    groups = max(LEAST_GROUPS, (held or 0) // GROUP_ROWS)
    few = keyed.join(least.filter(F.col("texts") <= KEY_TEXTS).select("key"), "key").join(maps, "node")
    few = few.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    links = few.groupBy("group").applyInPandas(lambda frame: _may_link(frame, percent), "a bigint, b bigint")
    if (crowded or 0) > KEY_TEXTS:
        many = keyed.join(least.filter(F.col("texts") > KEY_TEXTS), "key")
        links = links.unionByName(many.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    roots, kept = stage(components(links), "clusters")
    discard(sets.sparkSession, path, at)
    return roots, [kept]


def linked_pairs(sizes: np.ndarray, tokens: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets as all their links would. With ``side`` only links between the two sides count."""
    counts = np.array([len(t) for t in tokens])
    ids = np.unique(np.concatenate(tokens), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(tokens)), counts)
    order = np.argsort(ids, kind="stable")
    holders, starts = owner[order], np.searchsorted(ids[order], np.arange(ids.max(initial=-1) + 2))
    begin = np.r_[0, np.cumsum(counts)]
    label, links = np.arange(len(tokens)), []
    for x in range(len(tokens)):
        own = ids[begin[x] : begin[x + 1]]
        span = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        both = np.bincount(holders[at], minlength=len(tokens))
        near = (100 * both >= percent * (sizes[x] + sizes - both)) & (both > 0)
        near[: x + 1] = False
        if side is not None:
            near &= side != side[x]
        for y in np.flatnonzero(near):
            if label[y] != label[x]:
                links.append((x, int(y)))
                label[label == label[y]] = label[x]
    return links


def verified(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the nodes of each cluster as all links between them would."""
    # Narrow rows are joined first; the tokens then move to the tasks by way of one join, and only those of clusters.
    sized = sets.select("node", F.size("tokens").alias("held")).join(roots, "node")
    per_root, path = stage(sized.groupBy("root").agg(F.count("*").alias("texts"), F.sum("held").alias("held")), "cluster-sizes")
    blocks = F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("held") / BLOCK_TOKENS)).cast("int")
    small = per_root.filter((F.col("texts") <= BLOCK_TEXTS) & (F.col("held") <= BLOCK_TOKENS)).agg(F.sum("held")).first()[0]
    batches = max(1, -(-(small or 0) // (BLOCK_TOKENS // 4)))
    known, at_known = stage(sized.join(per_root.select("root", blocks.alias("blocks")), "root").drop("held"), "clustered")
    member = bloom.filled(known.select(F.col("node").alias("_key")), known.count())
    placed = bloom.passing(sets, member, "node").join(known, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A batch of small clusters is one group; a large one is a group for each pair of its blocks.
    group = F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(batches)))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = placed.select("node", "n", "tokens", "blocks", group.alias("group"), own.alias("own"), other.alias("other")).select(
        "node", "n", "tokens", "own", "group", (F.col("blocks") > 1).alias("large"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["own"].to_numpy() if frame["i"].iloc[0] != frame["j"].iloc[0] else None
        tokens = [np.asarray(t, dtype=np.int64) for t in frame["tokens"]]
        links = linked_pairs(frame["n"].to_numpy(np.int64), tokens, side, percent)
        nodes = frame["node"].to_numpy(np.int64)
        a, b = (np.array([link[i] for link in links], dtype=np.int64) for i in (0, 1))
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    found, at = stage(rows.groupBy("group", "large", "i", "j").applyInPandas(verify, "a bigint, b bigint"), "links-found")
    discard(sets.sparkSession, path, at_known)
    return found


def joined(docs: DataFrame, text: str = "text", row_id: str = "doc_id", words: int = 4, percent: int = 85) -> DataFrame:
    """Per row: its id, _text (a hash of its text), n_shingles, component (a number) and component_id (its least id)."""
    rows, _ = stage(signed(docs, text, row_id, words, percent), "signed")
    able, held = stage(possible(rows, percent), "possible")
    repeats = not rows.groupBy(row_id, "_text").count().filter("count > 1").isEmpty()
    sets, paths = shared_sets(docs, able, text, row_id, words, repeats)
    roots, more = clusters(sets, percent)
    links = verified(sets, roots, percent)
    joins, _ = stage(components(links), "components")
    discard(docs.sparkSession, held, *paths, *more)
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(row_id).alias("first"))
    named = nodes.join(joins, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named, _ = stage(named, "nodes")
    # Only components of several nodes need another name than their node's.
    least = named.join(joins.select("root").distinct(), "root").groupBy("root").agg(F.min("first").alias("least"))
    final, _ = stage(named.join(least, "root", "left").select(
        "node", "root", F.coalesce("least", "first").alias("component_id")), "components-named")
    narrow = rows.select(F.col(row_id), "_text", "node", F.col("n").alias("n_shingles"))
    return narrow.join(final, "node", "left").select(
        row_id, "_text", "n_shingles", F.col("root").alias("component"),
        F.when(F.col("node").isNull(), F.col(row_id)).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", row_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that another of their component stands for: the one with the least id stays.

    Rows without shingles all stay, but for repeats. Of rows of the same id and text the one with the least hash of all its
    columns stays. Columns stay as they are, whatever their names.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    row = F.struct("id", "_text")
    with scratch(spark):
        found, _ = stage(joined(named, "text", "id", words, percent).select("id", "_text", "component"), "joined")
        kept = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(row).alias("kept"))
        kept, _ = stage(kept, "kept")  # written, so that the join can split a component of very many copies
        gone = found.join(kept, "component").filter(~row.eqNullSafe(F.col("kept"))).select(
            F.col("id").alias("gone_id"), F.col("_text").alias("gone_text"))
        gone, _ = staged(gone.distinct(), "copies")
        repeats = found.groupBy("id", "_text").count().filter("count > 1").join(gone, _is_gone("_text"), "left_anti")
        repeated = not repeats.isEmpty()
    rows = docs.select(packed(docs), F.col(row_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"))
    left = bloom.without(rows, gone, F.xxhash64("id", "hash"), F.xxhash64("gone_id", "gone_text"), _is_gone("hash"))
    if repeated:
        left = left.groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return left.select("row.*")


def _is_gone(text: str) -> Column:
    return F.col("id").eqNullSafe(F.col("gone_id")) & (F.col(text) == F.col("gone_text"))
