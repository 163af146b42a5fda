"""Data-stream definitions from XML, and bits cut out of packets."""

import random

from pyspark.sql import functions as F

from revscope.sources import packets as P

ADX = """<ADXFORMAT>
<ADXHEADER><guid>g-1</guid><author>someone</author><desc>a stream</desc><baud>8192</baud><objectcount>5</objectcount></ADXHEADER>
<ADXCSENDCOMMAND id="M1" idhash="0x00000001" title="Mode 1"><bytestring size="0x06">F45701000034</bytestring></ADXCSENDCOMMAND>
<ADXVALUE id="RPM" idhash="0x11" title="Engine speed"><parentcmdidhash>0x00000001</parentcmdidhash><units>rpm</units><packetoffset>0x02</packetoffset><sizeinbits>16</sizeinbits><outputtype>1</outputtype><MATH equation="X * 0.125"/></ADXVALUE>
<ADXVALUE id="FLAG" idhash="0x12" title=""><parentcmdidhash>0x00000001</parentcmdidhash><packetoffset>0x04</packetoffset><sizeinbits>1</sizeinbits><bitoffset>7</bitoffset><MATH equation="X"/></ADXVALUE>
<ADXVALUE id="LOAD" idhash="0x13" title="Load"><parentcmdidhash>0x00000001</parentcmdidhash><packetoffset>0x00</packetoffset><MATH equation="RPM*MAP"/></ADXVALUE>
<ADXVALUE id="FREE" idhash="0x14" title="Free"><packetoffset>0x03</packetoffset><MATH equation="X"/></ADXVALUE>
</ADXFORMAT>"""


def test_definition_file(spark, tmp_path):
    path = tmp_path / "x.adx"
    path.write_text(ADX)
    head = P.read_header(spark, str(path)).first()
    assert (head.author, head.baud, head.objects) == ("someone", 8192, 5)
    command = P.read_commands(spark, str(path)).first()
    assert (command.command, command.title, command.size, bytes(command.frame)) == ("0x00000001", "Mode 1", 6, bytes.fromhex("F45701000034"))
    values = {r.id: r for r in P.read_values(spark, str(path)).collect()}
    assert {k: v.raw for k, v in values.items()} == {"RPM": True, "FLAG": True, "LOAD": False, "FREE": False}
    assert (values["RPM"].offset, values["RPM"].bits, values["FLAG"].bit, values["FLAG"].title) == (2, 16, 7, None)
    packets = spark.createDataFrame([(0, 0, "0x00000001", bytes.fromhex("F4530FA001")), (0, 1, "0x00000001", b"\xf4"), (0, 2, "0x09", b"123456"), (0, 3, "0x00000001", None)], "log_id long, row_idx long, command string, payload binary")
    got = {(r.row_idx, r.value_id): r.value for r in P.decoded(packets, P.read_values(spark, str(path))).collect()}
    assert got == {(0, "RPM"): 500.0, (0, "FLAG"): 1.0, (1, "RPM"): None, (1, "FLAG"): None, (3, "RPM"): None, (3, "FLAG"): None}


def test_bits_anywhere(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        payload = rng.randbytes(rng.randint(0, 12))
        begin, bits = rng.randint(0, 80), rng.randint(0, 50)
        text = "".join(f"{b:08b}" for b in payload)
        rows.append((payload, begin, bits, int(text[begin : begin + bits], 2) if 1 <= bits <= 48 and begin + bits <= len(text) else None))
    df = spark.createDataFrame(rows, "payload binary, b int, n int, wanted long").withColumn("got", P.bits_of(F.col("payload"), F.col("b"), F.col("n")))
    assert df.where(~F.col("got").eqNullSafe(F.col("wanted"))).count() == 0 and df.where("got is not null").count() > 20


def test_equations(spark):
    wanted = {"X": (1.0, 0.0), "x*0.5": (0.5, 0.0), "X/4 - 40": (0.25, -40.0), "X*1.35+-40": (1.35, -40.0), "X+3": (1.0, 3.0), "X*Y": (None, None), "RPM*2": (None, None), "X/0": (None, 0.0), "": (None, None), None: (None, None)}
    factor, shift = P.affine(F.col("e"))
    got = {r.e: (r.f, r.s) for r in spark.createDataFrame([(e,) for e in wanted], "e string").select("e", factor.alias("f"), shift.alias("s")).collect()}
    assert got == wanted
