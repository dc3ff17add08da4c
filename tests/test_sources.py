import random
import struct

import pytest

from twinmark.__main__ import main
from twinmark.operators import headers
from twinmark.plans import runs
from twinmark.sources import bam, bam_codec, bgzf, sam, timing, tsv

HEADER = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:1000000", "@RG\tID:A\tSM:s\tLB:l1"]


def lines(n, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        pos = rng.randrange(1, 200)
        for flag, p in ((99, pos), (147, pos + 100)):
            out.append(f"q{i}\t{flag}\tchr1\t{p}\t60\t5S45M\t=\t{p}\t0\t{'ACGTN' * 10}\t{'I' * 50}\tRG:Z:A\tNM:i:{rng.randrange(-70000, 70000)}\tXF:f:1.5\tXB:B:s,1,-2\tXA:A:z\tXH:H:1F")
    return out


def write(path, rows, header=HEADER):
    path.write_text("\n".join([*header, *rows]) + "\n")
    return str(path)


def test_bgzf(tmp_path):
    data = random.Random(1).randbytes(200_000)
    for level in (0, 1, 6, 12):
        (tmp_path / "x").write_bytes(bgzf.compress(data, level) + bgzf.EOF)
        with open(tmp_path / "x", "rb") as f:
            got = b""
            while (b := bgzf.read_block(f)) is not None:
                got += b
            assert got == data and len(list(bgzf.blocks(f))) == 5
    broken = bytearray(bgzf.compress(data[:100], 0))
    broken[40] ^= 1
    (tmp_path / "x").write_bytes(broken)
    with open(tmp_path / "x", "rb") as f, pytest.raises(ValueError, match="checksum"):
        bgzf.read_block(f)
    with open(tmp_path / "x", "rb") as f:
        assert len(bgzf.read_block(f, check_crc=False)) == 100


def test_codec():
    row = dict(qname="q", flag=99, rname="c", pos=7, mapq=3, cigar="3M2S", rnext="=", pnext=9, tlen=-4, seq="ACGTa", qual="IIIII", aux=["NM:i:-5", "XI:i:4294967295", "XB:B:f,1.5,2"])
    data = bam_codec.encode(row, {"c": 0})
    assert struct.unpack("<I", data[:4])[0] == len(data) - 4
    assert bam_codec.decode(data[4:], ["c"]) == ("q", 99, "c", 7, 3, "3M2S", "c", 9, -4, "ACGTA", "IIIII", row["aux"])
    for bad in ({"cigar": "0M"}, {"cigar": "5"}, {"qual": "I"}, {"aux": ["X"]}, {"aux": ["XX:B:c,300"]}, {"qname": "q" * 255}):
        with pytest.raises(ValueError):
            bam_codec.encode(row | bad, {"c": 0})


def test_sam_scan_and_bam_round_trip(spark, tmp_path):
    body = lines(3000)
    path = write(tmp_path / "a.sam", body)
    got = sam.scan(spark, path).orderBy("line_no").collect()
    assert [r.value for r in got] == HEADER + body and [r.line_no for r in got] == list(range(len(got)))
    header, rows = runs.load(spark, path)
    assert header == HEADER and rows.agg({"ord": "max"}).first()[0] == 2999
    out = str(tmp_path / "b.bam")
    bam.write(rows.orderBy("ord", "rec_idx"), out, header, 6)
    for size in (1 << 26, 20_000):
        back = sam.numbered(bam.read(spark, out, splitBytes=str(size)), ["split"], "row").orderBy("line_no").collect()
        assert [r.qname for r in back] == [b.split("\t")[0] for b in body]
        assert [r.aux for r in back] == [b.split("\t")[11:] for b in body]
    assert bam.detect_format(out) == "bam" and bam.detect_format(path) == "sam"


def bam_file(path, rows):
    header = b"@SQ\tSN:chr1\tLN:1000000\n"
    data = bam.MAGIC + struct.pack("<i", len(header)) + header + struct.pack("<ii", 1, 5) + b"chr1\0" + struct.pack("<i", 1000000)
    base = dict(flag=0, rname="chr1", pos=7, mapq=3, cigar="*", rnext="*", pnext=0, tlen=0, seq="*", qual="*", aux=[])
    data += b"".join(bam_codec.encode(base | r, {"chr1": 0}) for r in rows)
    path.write_bytes(bgzf.compress(data, 1) + bgzf.EOF)
    return str(path)


def bam_names(path, size):
    reader = bam.BamReader({"path": path, "splitBytes": str(size)})
    return [row[2] for part in reader.partitions() for row in reader.read(part)]


def test_bam_ranges_of_long_records(tmp_path):
    rng, rows = random.Random(1), []
    for i in range(24):
        n = (300, 90_000, 400_000)[i % 3]
        rows.append(dict(qname=f"r{i}", seq="".join(rng.choices("ACGT", k=n)), qual="".join(rng.choices("#(-27<AF", k=n)), aux=["mv:B:c," + ",".join(rng.choices("01", k=n // 5))]))
    path = bam_file(tmp_path / "a.bam", rows)
    for size in (1 << 26, 1_000_000, 200_000, 70_000):
        assert bam_names(path, size) == [r["qname"] for r in rows], size


def test_bam_ranges_that_cannot_be_told(tmp_path):
    rows = [dict(qname=f"r{i}", seq="A" * 30_000, qual="".join(random.Random(i).choices("#(-27<AF", k=30_000))) for i in range(40)]
    assert bam_names(bam_file(tmp_path / "a.bam", rows), 70_000) == [r["qname"] for r in rows]
    for odd in rows:  # names that BAM doesn't allow are no plausible starts
        odd["qname"] = "r\x01"
    path = bam_file(tmp_path / "b.bam", rows)
    assert len(bam_names(path, 1 << 26)) == 40
    with pytest.raises(ValueError, match="splitBytes"):
        bam_names(path, 70_000)


def test_command_line(spark, tmp_path):
    path = write(tmp_path / "a.sam", lines(300))
    out, stats = str(tmp_path / "o.bam"), str(tmp_path / "s.tsv.gz")
    assert main(["mark", "-i", path, "-o", out, "--stats", stats, "--add-mate-tags", "-q"], spark) == 0
    header, rows = runs.load(spark, out)
    assert header[-1].startswith("@PG\tID:TWINMARK") and rows.filter("mc is null").count() == 0
    n = rows.filter("flag & 1024 <> 0").count()
    assert 0 < n < 600
    again = str(tmp_path / "p.bam")
    assert main(["mark", "-i", out, "-o", again, "-q"], spark) == 0
    header, rows = runs.load(spark, again)
    assert header[-1].startswith("@PG\tID:TWINMARK-TWINMARK") and "PP:TWINMARK" in header[-1] and rows.filter("flag & 1024 <> 0").count() == n
    assert main(["mark", "-i", path, "-o", str(tmp_path / "o.sam")], spark) == 1
    bad = write(tmp_path / "c.sam", ["q\t0\tchr1\t1\t60\t5000H50M\t*\t0\t0\t*\t*"])
    assert main(["mark", "-i", bad, "-o", str(tmp_path / "c.bam"), "-q"], spark) == 1 and (tmp_path / "c.bam").exists()


def test_programs(spark):
    pg = lambda *rows: spark.createDataFrame([(i, i, "1", p, None) for i, p in rows], headers.PROGRAMS)
    assert {(r.id, r.pp) for r in headers.with_program(spark, pg(("a", None), ("b", "a"), ("c", "a")), "X", "1", "x").collect()} >= {("X", "b"), ("X-c", "c")}
    with pytest.raises(ValueError, match="gone"):
        headers.with_program(spark, pg(("a", "gone")), "X", "1", "x")


def test_reports(spark, tmp_path):
    row = spark.createDataFrame([("a", 0.28, None)], "s string, f double, n long")
    tsv.append(row, str(tmp_path / "x.tsv"))
    tsv.append(row, str(tmp_path / "x.tsv"))
    assert (tmp_path / "x.tsv").read_text() == "s\tf\tn\na\t0.280000\t\na\t0.280000\t\n"
    d = tmp_path / "r/s1/toolx/rep1"
    d.mkdir(parents=True)
    (d / "time.devnull.txt").write_text("\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.50\n\tUser time (seconds): 2.5\n\tPercent of CPU this job got: 97%\n\tExit status: 0\n")
    got = timing.collate(spark, str(tmp_path / "r")).first()
    assert (got.sample, got.tool, got.rep, got.wall_s, got.user_s, got.cpu_percent, got.max_rss_kb, got.exit_status) == ("s1", "toolx", 1, 62.5, 2.5, 97, None, 0)


def test_bad_lines(spark):
    df = spark.createDataFrame([(0, "q\t0\tc\t1"), (1, "q\t99999\tc\t1\t0\t*\t*\t0\t0\t*\t*"), (2, "q\t0\tc\tx\t0\t*\t*\t0\t0\t*\t*"), (3, "q\t0\tc\t1\t0\t*\t*\t0\t0\tAC\tI"), (4, "q\t0\tc\t1\t0\t*\t*\t0\t0\tAC\tII\r"), (5, "")], "line_no long, value string")
    got = [r.error for r in sam.records(df).orderBy("line_no").collect()]
    assert [e is None for e in got] == [False, False, False, False, True]
    with pytest.raises(ValueError, match="line 1"):
        sam.check(sam.records(df))
