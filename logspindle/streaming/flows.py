"""IPFIX and NetFlow v9 from streams, with the templates of each exporter as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.flows import _FLOW, FLOW_SCHEMA, MAX_TEMPLATES, finish, records, sets_of
from ..ship import ship


def decode(exporter: str, frames: Iterator[pd.DataFrame], templates: dict[str, list]) -> pd.DataFrame:
    """Flows of one exporter's datagrams in order of ``seq``; ``templates`` is read and changed."""
    rows = []
    for seq, payload in sorted((int(s), bytes(p)) for f in frames for s, p in zip(f["seq"], f["payload"], strict=True)):
        version, domain, seconds, sets, _ = sets_of(payload)
        for part, (kind, tid, what) in enumerate(sets):
            key = f"{domain}/{tid}"
            if kind == "template":
                if key in templates or len(templates) < MAX_TEMPLATES:
                    templates[key] = what
            elif key in templates:
                for i, r in enumerate(records(templates[key], what)):
                    rows.append(r | {"seq": seq, "part": part, "record_no": i, "observation_domain_id": domain, "template_id": tid, "protocol_version": version, "exporter": exporter, "export_seconds": seconds})
    from decimal import Decimal

    out = pd.DataFrame(rows, columns=[n for n, _ in _FLOW]).astype(object)
    for big in ("octet_delta_count", "packet_delta_count"):
        out[big] = [None if v is None or v != v else Decimal(int(v)) for v in out[big]]
    return out.where(out.notna(), None)


def decode_stream(datagrams: DataFrame) -> DataFrame:
    """Flow rows of a streaming frame (payload, exporter, seq); equals ``decode_flows`` on the same datagrams."""
    ship(datagrams.sparkSession)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        templates = json.loads(state.get[0]) if state.exists else {}
        out = decode(key[0], frames, templates)
        state.update((json.dumps(templates),))
        yield out

    raw = datagrams.select("payload", "exporter", "seq").groupBy("exporter").applyInPandasWithState(step, FLOW_SCHEMA, "templates string", "append", GroupStateTimeout.NoTimeout)
    return finish(raw)
