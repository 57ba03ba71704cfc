"""Packing by minimum bin slack.

Each bin takes the longest piece left and, with it, the combination of the lengths left that comes nearest to the
capacity: a subset-sum over the available lengths, the reachable sums being the bits of one integer. The combination is
then removed. Where the counts allow, the same combination serves as many bins as they last for, since it stays the
fullest one until one of its lengths runs short. The plan's size follows the number of lengths, not of pieces. Of
combinations of one sum, the order of lengths fixes which is taken; pieces of one length take its places in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .packing import CAPACITY, END_ID, Plan, pieces, place


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length (at most its count) make the largest sum up to room, longer ones tried first."""
    goal, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((k for k, n in counts.items() if n and k <= room), reverse=True):
        before = reach
        for _ in range(min(counts[length], room // length)):
            more = reach | reach << length & goal
            if more == reach:
                break
            reach = more
        steps.append((length, before))
        if reach >> room:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        k = 0
        while not before >> best & 1:
            best, k = best - length, k + 1
        if k:
            taken[length] = k
    return taken


def minimum_slack(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for counts[length] pieces of each length."""
    left, used, plan = {k: n for k, n in counts.items() if n}, dict.fromkeys(counts, 0), Plan()
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = fullest(left, capacity - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in taken.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            plan.runs.append((length, used[length], taken[length], plan.bins, offset))
            offset += length * taken[length]
            used[length] += bins * taken[length]
            left[length] -= bins * taken[length]
            if not left[length]:
                del left[length]
        plan.bins += bins
    return plan


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """table (doc_id, piece, length, ...) with sequence_id and offset."""
    return place(table, minimum_slack, capacity)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """The pieces of docs with their ids and places."""
    return pack(pieces(docs, path, capacity, end_id), capacity)
