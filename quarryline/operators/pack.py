"""Next-fit packing in the given order, bounded by items and size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def next_fit(rows: DataFrame, scope: str, order: list[str], size: str, most_items: int, most_size: int) -> DataFrame:
    """rows with packet (1-based within scope) and place: a packet closes when the next row would not fit.

    Ranges of a sorted shuffle by scope stream through the workers, so a scope is never held as a whole.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, packet, place, used = None, 0, 0, 0
        for frame in frames:
            packets, places = [], []
            for s, n in zip(frame[scope], frame[size], strict=True):
                if s != now:
                    now, packet, place, used = s, 1, 0, 0
                elif place >= most_items or used + n > most_size:
                    packet, place, used = packet + 1, 0, 0
                place, used = place + 1, used + n
                packets.append(packet)
                places.append(place)
            yield frame.assign(packet=packets, place=places)

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, packet long, place long"
    return rows.repartition(scope).sortWithinPartitions(scope, *order).mapInPandas(pack, schema)
