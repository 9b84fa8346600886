"""Sets that overlap: counts of shared members for all pairs, and sets that hold most of a picked one.

Both take a table of memberships, one row for a set and a member (``distinct`` first). Rows without set or
member count for nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.scale import row_index, running_totals
from reachgrid.session import checkpoint

#: A member is heavy when it is in more sets than this and in more than one in so many of all rows.
LEAST, SHARE = 10_000, 1000
#: Neighbouring picks that stay together, memberships of picks that are counted in one block (and those of the last picks
#: beyond it), memberships that meet them in one task; picks above ``LARGE`` members go alone.
PICKS, ROWS, HELD, LARGE = 256, 600_000, 2_000_000, 1000
#: Memberships of sets that are counted for a pick at once.
COUNTED = 4_000_000


def set_patterns(members: DataFrame, group: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(sets, n), sets being numbers in ascending order, and (_no, ``group``) to read them by; numbers follow the names' order.

    Every member's sets become a bitmap, 64 set numbers a word; members with the same bitmap are one row with
    their number ``n``. Members of one set only are left out.
    """
    known = members.where(F.col(group).isNotNull() & F.col(member).isNotNull())
    numbers = row_index(known.select(group).distinct(), group, name="_no")
    word = (F.col("_no") / 64).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_no") % 64).cast("int"))
    words = known.select(group, member).join(numbers, group).groupBy(member, word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    bitmap = F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap")
    maps = words.groupBy(member).agg(bitmap, F.sum(F.bit_count("bits")).alias("k")).where("k > 1")
    patterns = maps.groupBy("bitmap").agg(F.count("*").alias("n"))

    def numbers_of(w: Column) -> Column:
        here = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", w["bits"], b).bitwiseAND(F.lit(1)) == 1)
        return F.transform(here, lambda b: w["word"].cast("bigint") * 64 + b)
    return patterns.select(F.flatten(F.transform("bitmap", numbers_of)).alias("sets"), "n"), numbers


def shared_members(members: DataFrame, group: str, member: str, *, first: str = "a", second: str = "b") -> DataFrame:
    """(first, second, shared) for every two sets with members in common; ``first`` is the smaller name.

    Pairs are made once for each distinct combination of sets, however many members have it, and the numbers
    of members are added up; a member of a thousand sets alone makes half a million pairs, which is what it shares.
    """
    patterns, numbers = set_patterns(members, group, member)
    one = patterns.select("sets", "n", F.posexplode("sets").alias("at", "_a"))
    pairs = one.select("_a", F.explode(F.slice("sets", F.col("at") + 2, F.size("sets"))).alias("_b"), "n")
    shared = pairs.groupBy("_a", "_b").agg(F.sum("n").alias("shared"))
    names = [numbers.select(F.col("_no").alias(k), F.col(group).alias(name)) for k, name in (("_a", first), ("_b", second))]
    return shared.join(names[0], "_a").join(names[1], "_b").select(first, second, "shared")


def _counted(rows: DataFrame, heavy: DataFrame, light: DataFrame, member: str) -> DataFrame:
    """``rows`` with ``df`` of their member and ``parts`` (NULL where light), without a task for a heavy member."""
    marked = rows.join(F.broadcast(heavy), member, "left")
    few = marked.where("parts is null").drop("df", "parts").join(light, member).select(*rows.columns, "df", F.lit(None).cast("int").alias("parts"))
    return marked.where("parts is not null").select(*rows.columns, "df", "parts").unionByName(few)


def mostly_contained(picks: DataFrame, members: DataFrame, group: str, member: str, share: float, *,
                     least: int = LEAST, heavy_share: int = SHARE) -> DataFrame:
    """(pick, group, share) of other sets that hold at least ``share`` of a picked set's members.

    picks: ``group`` of the picked sets. A set that holds c of n members holds one of any n - c + 1, so only the
    rarest so many members of a pick look for candidates; the exact share is then counted for candidates alone.
    A member that is in a large part of all sets is dealt over tasks by its sets; there are fewer than
    ``heavy_share`` such members, whatever the data, so their list may be broadcast.
    """
    if not 0 < share <= 1:
        raise ValueError("share is above 0 and at most 1")
    # Both are asked for several times, and behind them may stand anything.
    known = checkpoint(members.select(group, member).where(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct())
    counts = known.groupBy(member).agg(F.count("*").alias("df"))
    bound = F.greatest(F.lit(least), F.ceil(counts.agg(F.sum("df")).scalar() / heavy_share)).cast("bigint")
    heavy = counts.where(F.col("df") > bound).select(member, "df", F.ceil(F.col("df") / bound).cast("int").alias("parts"))
    light = counts.where(F.col("df") <= bound)
    wanted = picks.select(F.col(group).alias("pick")).where("pick is not null").distinct()
    sizes = checkpoint(known.groupBy(F.col(group).alias("pick")).agg(F.count("*").alias("k")).join(wanted, "pick", "left_semi"))
    small = _counted_in_blocks(sizes.where(F.col("k") <= LARGE), known, counts, heavy.select(member, "df"), group, member, share)
    large = checkpoint(sizes.where(F.col("k") > LARGE))
    if large.isEmpty():  # else the memberships would be shuffled four times for nothing
        return small
    mine = known.withColumnRenamed(group, "pick").join(large, "pick", "left_semi")
    # Rare members first; the hash breaks ties, so that a pick of equally rare members does not ask by all of them.
    order = F.col("df") * (1 << 20) + F.pmod(F.xxhash64(member), F.lit(1 << 20))
    ranked = _counted(mine, heavy, light, member).withColumn("order", order)
    run = running_totals(ranked.groupBy("pick", "order").agg(F.count("*").alias("n")), ["pick"], "order", {"run": F.col("n")})
    need = F.col("k") - F.ceil(F.col("k") * (share * (1 - 1e-12))) + 1
    limits = run.join(large, "pick").where(F.col("run") >= need).groupBy("pick").agg(F.min("order").alias("limit"))
    asked = checkpoint(ranked.join(limits, "pick").select("pick", member, "parts", (F.col("order") <= F.col("limit")).alias("asks")))
    asking = asked.where("asks").select("pick", member, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    dealt = known.join(F.broadcast(heavy.drop("df")), member, "left")
    dealt = dealt.select(group, member, F.coalesce(F.pmod(F.xxhash64(group), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    found = asking.join(dealt, [member, "part"]).where(F.col("pick") != F.col(group)).select("pick", group).distinct()
    common = found.join(asked.select("pick", member), "pick").join(known, [group, member], "left_semi").groupBy("pick", group).agg(F.count("*").alias("n"))
    ratio = F.col("n") / F.col("k")
    return common.join(large, "pick").where(ratio >= share).select("pick", group, ratio.alias("share")).unionByName(small)


def _counted_in_blocks(sizes: DataFrame, known: DataFrame, counts: DataFrame, heavy: DataFrame, group: str, member: str, share: float) -> DataFrame:
    """(pick, group, share) of small picks: blocks of neighbouring picks meet the memberships of their members.

    Most pairs of sets that share a member share too few, so the pairs are counted inside a task and only those
    that hold enough leave it. Sets go to blocks by the members they share; a block's sets are dealt over tasks.
    A block is as many picks as hold ``ROWS`` members: a set goes to every block that has a member of it, so the
    fewer blocks the less is sent. Which members of a pick ask is found out in the task, nothing is ranked before.
    """
    kind = sizes.schema["pick"].dataType.simpleString()
    numbers = row_index(sizes, "pick", name="_no").withColumn("_near", F.floor(F.col("_no") / PICKS))
    near = numbers.groupBy("_near").agg(F.sum("k").alias("_rows")).withColumn("_all", F.lit(0))
    run = running_totals(near, ["_all"], "_near", {"_run": F.col("_rows")}).select("_near", F.floor((F.col("_run") - 1) / ROWS).alias("_block"))
    # Merge joins and hash joins dealt by key: Spark would broadcast a table of numbers, whose file is small.
    blocks = numbers.hint("merge").join(run, "_near").select("pick", "_block")
    mine = known.withColumnRenamed(group, "pick").join(blocks.hint("shuffle_hash"), "pick").join(F.broadcast(heavy), member, "left")
    mine = checkpoint(mine.select("_block", "pick", member, "df"))
    askers = checkpoint(mine.select("_block", member).distinct())
    shares = checkpoint(askers.join(counts.withColumnRenamed("df", "_df"), member).groupBy("_block").agg(F.ceil(F.sum("_df") / HELD).alias("_n")))
    left = mine.join(shares, "_block").select("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_task"), "pick", member, "df")
    held = known.join(askers.hint("shuffle_hash"), member).join(shares, "_block")
    right = held.select(F.col("_block").alias("_in"), F.pmod(F.xxhash64(group), F.col("_n")).alias("_of"), group, member)
    return left.groupBy("_block", "_task").cogroup(right.groupBy("_in", "_of")).applyInArrow(
        _shares(group, member, share), f"pick {kind}, `{group}` {known.schema[group].dataType.simpleString()}, share double")


def _coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct values of the columns and their places there; -1 where a later column has others."""
    first = columns[0].combine_chunks().dictionary_encode()
    codes = [first.indices.to_numpy()] + [pc.fill_null(pc.index_in(c.combine_chunks(), first.dictionary), -1).to_numpy() for c in columns[1:]]
    return first.dictionary, [c.astype(np.int32) for c in codes]


def _shares(group: str, member: str, share: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Pairs of a block: every pick's paired members bring their sets, members of very many sets are only counted for pairs found.

    A set that holds c of n members holds one of any n - c + 1: light members are paired, and of the heavy ones (those
    with ``df``) the rarest, as many as that takes.
    """
    def pairs(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        _, (at, has) = _coded(asked.column(member), held.column(member))
        picks, (who,) = _coded(asked.column("pick"))
        groups, (set_of,) = _coded(held.column(group))
        n_sets, k = max(len(groups), 1), np.bincount(who, minlength=len(picks))
        own = pc.fill_null(pc.index_in(picks, groups), -1).to_numpy()
        enough = np.ceil(k * (share * (1 - 1e-12))).astype(np.int64)
        df = pc.fill_null(asked.column("df"), 0).to_numpy()
        order = np.lexsort((at, df, who))  # light members first, then the rarest
        who, at, df = who[order], at[order], df[order]
        paired = (df == 0) | (np.arange(len(who)) - (np.cumsum(k) - k)[who] <= (k - enough)[who])
        del order, df
        marks = np.unique(at[~paired])
        mine, theirs = _marked(who[~paired], at[~paired], len(picks), marks), _marked(set_of, has, n_sets, marks)
        unpaired = np.bincount(who[~paired], minlength=len(picks))
        by = np.argsort(has, kind="stable")
        sets, has = set_of[by], has[by]
        del set_of, by
        who, at = who[paired], at[paired]
        starts, ends = np.searchsorted(has, at), np.searchsorted(has, at, side="right")
        bounds, upto = np.searchsorted(who, np.arange(len(picks) + 1)), np.concatenate([[0], np.cumsum(ends - starts)])
        out = []
        for p in range(len(picks)):
            first, last = bounds[p], bounds[p + 1]
            n, least = upto[last] - upto[first], max(enough[p] - unpaired[p], 1)
            if 8 * n < n_sets and n <= COUNTED:  # few: sorted, else counted in a place for every set
                found, count = np.unique(np.concatenate([sets[:0], *(sets[i:j] for i, j in zip(starts[first:last], ends[first:last]))]), return_counts=True)
                found, count = found[count >= least], count[count >= least]
            else:
                count = np.zeros(n_sets, np.int64)
                while first < last:
                    upper = max(np.searchsorted(upto, upto[first] + COUNTED, side="right") - 1, first + 1)
                    upper = min(upper, last)
                    count += np.bincount(np.concatenate([sets[i:j] for i, j in zip(starts[first:upper], ends[first:upper])]), minlength=n_sets)
                    first = upper
                found = np.flatnonzero(count >= least)
                count = count[found]
            if unpaired[p]:
                count = count + np.bitwise_count(mine[p] & theirs[found]).sum(axis=1)
            good = (count / k[p] >= share) & (found != own[p])
            if good.any():
                out.append((np.full(good.sum(), p), found[good], count[good] / k[p]))
        a, b, ratio = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"pick": picks.take(pa.array(a)), group: groups.take(pa.array(b)), "share": ratio})
    return pairs


def _marked(rows: np.ndarray, members: np.ndarray, n: int, marks: np.ndarray) -> np.ndarray:
    """A bit for each of ``marks`` that a row has among its members."""
    bits = np.zeros((n, -(-len(marks) // 64)), np.uint64)
    if len(marks):
        place = np.minimum(np.searchsorted(marks, members), len(marks) - 1)
        hit = marks[place] == members
        np.bitwise_or.at(bits, (rows[hit], place[hit] // 64), np.uint64(1) << (place[hit] % 64).astype(np.uint64))
    return bits
