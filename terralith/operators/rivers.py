"""River flow: the direction of every river tile, walked upstream from the mouths, and the swap of tiles at junctions.

The order of the walk decides ties, so a river system, the tiles that links join in either direction, is walked by one task;
systems are found for the whole map by joins, and walked side by side. A task holds one system.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators.graph import label_components, label_in_blocks
from terralith.operators.scratch import apart, settle

_OUT = "id bigint, system bigint, reached boolean, flow boolean, variant int, removed boolean"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def walk(mouths: list[int], ways: dict[int, list[tuple[int, list]]], variant: dict[int, int], takes: dict[int, list], junction: dict[int, bool]) -> tuple[set[int], dict[int, bool], set[int]]:
    """(reached, flow, removed) of one system; variant changes.

    A tile is walked once, but until then each tile that finds it sets its flow anew and queues it again: the last finder
    wins. A junction that is found against its stream becomes its first variant whose stream agrees, or goes.
    """
    flow, removed, walked = {}, set(), set()
    queue: list[int] = []
    k = 0
    for mouth in mouths:
        if mouth in walked or mouth in removed:
            continue
        walked.add(mouth)
        queue.append(mouth)
        while k < len(queue):
            here, k = queue[k], k + 1
            if here not in removed:
                for to, back in ways.get(here, ()):
                    if to in walked or to in removed or not takes[to][variant[to]]:
                        continue
                    enters = back[variant[to]]
                    if not junction[to]:
                        if enters is not None:
                            flow[to] = enters
                    elif enters:
                        fit = next((w for w, e in enumerate(back) if e is not None and not e), None)
                        if fit is None:
                            removed.add(to)
                        else:
                            variant[to] = fit
                    queue.append(to)
            walked.add(here)
    return set(queue), flow, removed


def _system(tiles: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    tiles = tiles.sort_values("id")
    ids = tiles["id"].tolist()
    ways: dict[int, list] = {}
    for s, d, back in links.sort_values(["src", "nth"])[["src", "dst", "back"]].itertuples(index=False):
        ways.setdefault(s, []).append((d, list(back)))
    variant = dict(zip(ids, tiles["variant"].tolist(), strict=True))
    reached, flow, removed = walk(tiles["id"][tiles["mouth"]].tolist(), ways, variant, dict(zip(ids, map(list, tiles["takes"]), strict=True)), dict(zip(ids, tiles["junction"].tolist(), strict=True)))
    return pd.DataFrame([(i, tiles["system"].iloc[0], i in reached, bool(flow.get(i, False)), variant[i], i in removed) for i in ids], columns=_NAMES)


def flow(tiles: DataFrame, links: DataFrame) -> DataFrame:
    """(id, system, reached, flow, variant, removed) of every tile.

    tiles: id, by which mouths come first; mouth; junction, a tile of three river links or more; variant, which of its forms
    stands there; takes, for each of its forms in order of preference whether some tested link is an entry. links: src, nth,
    dst, back: the river link nth of src leads onto dst, and back tells, for each form of dst, whether its link that leads
    back is an entry, null if none does; with src_block and dst_block, systems are labelled block by block, and only what meets
    over the borders of blocks goes through rounds. Tiles without links are systems of their own.
    """
    blocks = [c for c in ("src_block", "dst_block") if c in links.columns]
    links = settle(links.select("src", "nth", "dst", "back", *blocks))
    label = label_in_blocks if len(blocks) == 2 else label_components
    system = settle(label(tiles.select("id"), links.select("src", "dst", *blocks)).withColumnRenamed("comp", "system"))
    whole = tiles.select("id", "mouth", "junction", "variant", "takes").join(system, "id")
    own = links.select("src", "nth", "dst", "back").join(system.withColumnRenamed("id", "src"), "src")
    return whole.groupBy("system").cogroup(apart(own).groupBy("system")).applyInPandas(_system, _OUT)
