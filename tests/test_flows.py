"""Golden datagrams for the flow decoders, in batch and from a stream."""

import json
import random

from logspindle.operators import flows, netflow5, sflow
from logspindle.sources import network
from logspindle.streaming.flows import decode_stream

TEMPLATE_AND_DATA = "000a002c675cb0200000000100000000000200100100000200080004000c00040100000cc0a801010a000001"
TWO = "000a0034675cb0200000000200000000000200100100000200080004000c000401000014c0a801010a000001c0a801020a000002"
UNKNOWN = "000a0024675cb02000000002000000000002000c0101000103e7000401010008deadbeef"
MISSING = "000a0018675cb0200000000300000000012c0008aabbccdd"
OPTIONS_AND_DATA = "000a0036675cb020000000000000000100030016012c00020001009400080008000400000000012c00100000000000000007c0a8010a"
V9 = "00090002000f4240675cb0200000000100000005000000140100000300080004000c00040001000401000010ac10000108080808000003e8"
V5 = "00050001000f4240675cb020000000000000000100000000c0a8010ac0a80101000000000001000200000005000001f4000f4200000f423c1f900050001806000000000000000000"
SFLOW_IP4 = "00000005000000010a0000010000000000000002000007d00000000100000001000000480000000200000001000003e8000003e80000000000000003000000040000000100000003000000200000003c00000011ac100001080808080000c03a000000350000000000000000"
SFLOW_RAW = (
    "00000005000000010a0000010000000000000001000003e80000000100000001000000780000000100000001000002000000020000000000000000010000000200000001000000010000005000000001000000620000000000000040ffffffffffff"
    "0011223344550800450000540000000040060000c0a8010a0a0000021f9000500000000000000000500200000000000000000000000000000000"
)
SFLOW_COUNTER = (
    "00000005000000010a000001000000000000000300000bb800000001000000020000006c00000003000000010000000100000001000000580000000100000006000000003b9aca00000000010000000300000000000f4240000003e80000000a00000005"
    "000000000000000200000000000000000007a120000001f40000000300000001000000000000000100000000"
)


def frame(spark, *datagrams):
    return spark.createDataFrame([(i, e, bytearray.fromhex(h)) for i, (e, h) in enumerate(datagrams)], "seq long, exporter string, payload binary")


def decoded(spark, *datagrams):
    return flows.decode_flows(frame(spark, *datagrams)).orderBy("seq", "part", "record_no").collect()


def test_ipfix(spark):
    (a,) = decoded(spark, ("e", TEMPLATE_AND_DATA))
    assert (a.protocol_version, a.template_id, a.src_addr, a.dst_addr, a.observation_domain_id) == (10, 256, "192.168.1.1", "10.0.0.1", 0)
    assert a.export_time.isoformat() == "2024-12-13T22:07:28"
    assert [r.src_addr for r in decoded(spark, ("e", TWO))] == ["192.168.1.1", "192.168.1.2"]
    assert json.loads(decoded(spark, ("e", UNKNOWN))[0].extra) == {"ie999": "deadbeef"}


def test_templates_hold_for_their_exporter_from_then_on(spark):
    data_only = TEMPLATE_AND_DATA[:32] + TEMPLATE_AND_DATA[64:]
    data_only = data_only[:4] + "001c" + data_only[8:]
    rows = decoded(spark, ("a", data_only), ("a", TEMPLATE_AND_DATA), ("a", data_only), ("b", data_only))
    assert [(r.seq, r.exporter) for r in rows] == [(1, "a"), (2, "a")]
    missing = flows.missing_templates(frame(spark, ("a", data_only), ("b", data_only), ("c", MISSING))).collect()
    assert sorted((r.exporter, r.template_id, r.n_sets) for r in missing) == [("a", 256, 1), ("b", 256, 1), ("c", 300, 1)]


def test_datagram_files_in_name_order(spark, tmp_path):
    """Templates come before their data by name; the folder is the exporter."""
    data_only = TEMPLATE_AND_DATA[:4] + "001c" + TEMPLATE_AND_DATA[8:32] + TEMPLATE_AND_DATA[64:]
    for folder, name, text in (("r1", "000", data_only), ("r1", "001", TEMPLATE_AND_DATA), ("r1", "002", data_only), ("r2", "000", V9), ("r2", "001", V5), ("r3", "000", data_only)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.bin").write_bytes(bytes.fromhex(text))
    rows = network.read_datagrams(spark, str(tmp_path)).collect()
    assert [r.exporter for r in sorted(rows, key=lambda r: r.seq)] == ["r1", "r1", "r1", "r2", "r2", "r3"]
    got = flows.decode_datagrams(network.read_datagrams(spark, str(tmp_path))).collect()
    assert sorted((r.exporter, r.protocol_version) for r in got) == [("r1", 10), ("r1", 10), ("r2", 5), ("r2", 9)]


def test_an_exporter_without_a_name_has_templates(spark):
    assert len(decoded(spark, (None, V9))) == 1


def test_malformed_datagrams_lose_flows_but_not_templates(spark):
    broken = TEMPLATE_AND_DATA[:64] + "0100ffff" + TEMPLATE_AND_DATA[72:]
    version, _, _, sets, error = flows.sets_of(bytes.fromhex(broken))
    assert version == 10 and error and [s[0] for s in sets] == ["template"]
    assert flows.sets_of(bytes.fromhex("000a00"))[4] and flows.sets_of(b"")[4]


def test_netflow(spark):
    (a,) = decoded(spark, ("e", V9))
    assert (a.protocol_version, a.observation_domain_id, a.src_addr, a.dst_addr, int(a.octet_delta_count)) == (9, 5, "172.16.0.1", "8.8.8.8", 1000)
    (b,) = netflow5.decode_netflow_v5(frame(spark, ("e", V5), ("e", V5[:-2]), ("e", V9))).collect()
    assert (b.src_addr, b.src_port, b.dst_addr, b.dst_port, b.ip_protocol, b.tcp_flags) == ("192.168.1.10", 8080, "192.168.1.1", 80, 6, 24)
    assert (int(b.packet_delta_count), int(b.octet_delta_count), b.input_interface, b.output_interface) == (5, 500, 1, 2)
    assert json.loads(b.extra) == {"flowStartSysUpTime": 999936, "flowEndSysUpTime": 999996}


def test_ipv6_addresses_have_no_column():
    r = flows.flow([(27, 16, -1), (1, 2, -1), (5, 2, 9)], bytes(15) + b"\x01" + b"\x01\x00" + b"\xab\xcd")
    assert json.loads(r["extra"]) == {"sourceIPv6Address": "::1", "ie9:5": "abcd"} and r["octet_delta_count"] == 256


def test_sflow(spark):
    (a,) = sflow.samples(bytes.fromhex(SFLOW_IP4))
    assert (a["src_addr"], a["src_port"], a["dst_addr"], a["dst_port"], a["ip_protocol"], a["sampling_rate"], a["input_ifindex"], a["output_ifindex"]) == ("172.16.0.1", 49210, "8.8.8.8", 53, 17, 1000, 3, 4)
    (b,) = sflow.samples(bytes.fromhex(SFLOW_RAW))
    assert (b["src_addr"], b["src_port"], b["dst_addr"], b["dst_port"], b["sampling_rate"]) == ("192.168.1.10", 8080, "10.0.0.2", 80, 512)
    out = sflow.decode_sflow(frame(spark, ("x", SFLOW_COUNTER), ("x", "00"), ("x", SFLOW_IP4)))
    (c,) = sflow.counter_table(out).collect()
    assert (c.exporter, c.if_index, c.if_type, int(c.if_speed), int(c.if_in_octets), int(c.if_in_ucast_pkts), int(c.if_out_octets), c.if_in_errors, c.if_out_errors) == ("10.0.0.1", 1, 6, 10**9, 1000000, 1000, 500000, 2, 1)
    assert sflow.flow_table(out).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    df = frame(spark, ("a", TEMPLATE_AND_DATA), ("a", TWO), ("b", V9), ("b", MISSING))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = decode_stream(stream).writeStream.format("memory").queryName("flow_rows").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    pick = lambda rows: sorted((r.seq, r.exporter, r.src_addr, r.dst_addr, r.protocol_version) for r in rows)
    assert pick(spark.table("flow_rows").collect()) == pick(flows.decode_flows(df).collect())


def most_read(spark, frame):
    """Rows of a shuffle that the largest task of a run read, without adaptive merging."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup("most_read", "")
    try:
        frame.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    context, tracker = spark.sparkContext._jsc.sc(), spark.sparkContext.statusTracker()
    context.listenerBus().waitUntilEmpty()
    stages = {s for j in tracker.getJobIdsForGroup("most_read") for s in tracker.getJobInfo(j).stageIds}
    most = 0
    for s in stages:
        tasks = context.statusStore().taskList(s, 0, 1000)
        for i in range(tasks.size()):
            metrics = tasks.apply(i).taskMetrics()
            if metrics.isDefined():
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return most


def test_a_busy_exporter_spreads_over_tasks(spark):
    """Each of one exporter's datagrams repeats its template; neither the templates nor the data meet in one task."""
    n = 20_480
    for payload in (TEMPLATE_AND_DATA, OPTIONS_AND_DATA):
        df = spark.range(n).selectExpr("id AS seq", "'e' AS exporter", f"unhex('{payload}') AS payload")
        assert flows.decode_flows(df).count() == n
        assert 0 < most_read(spark, flows.decode_flows(df)) < n  # the datagrams' sets are 2 n


def test_latest_template_before_each_set(spark):
    """Against one pass over the sets in order: changing templates, spans without any, null exporters, a cap, numbers below 0 and far apart."""
    chance, rows = random.Random(5), []
    for seq in sorted({*range(-1500, 1500, 7), *(chance.randrange(-(2**62), 2**62) for _ in range(300)), *range(10**9, 10**9 + 300)}):
        for part in range(chance.randrange(4)):
            kind = chance.choices(["data", "template", "error"], [20, 1 if abs(seq) < 10**6 else 5, 1])[0]
            rows.append((chance.choice(["a", "b", None]), seq, part, 10, chance.randrange(2), 0, kind, chance.randrange(256, 258), str(chance.randrange(3)) if kind == "template" else None, b"", None))
    now, wanted = {}, {}
    for exporter, seq, part, _, domain, _, kind, tid, fields, *_ in rows:
        key = (exporter, domain, tid)
        if kind == "template" and (key in now or sum(k[0] == exporter for k in now) < 3):
            now[key] = fields
        elif kind == "data":
            wanted[seq, part] = now.get(key)
    assert len(set(wanted.values())) == 4
    chance.shuffle(rows)
    out = flows.with_templates(spark.createDataFrame(rows, flows._SETS), most=3)
    assert {(r.seq, r.part): r.fields for r in out.collect()} == wanted and out.count() == len(wanted)
