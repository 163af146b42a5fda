"""Free-form column headers to canonical signals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revscope.cluster import ship_package
from revscope.functions import scalars as S

#: The signals in their order of precedence and the names that loggers give them ('=' asks for the whole name).
ALIASES: dict[str, list[str]] = {
    "RPM": ["rpm", "engine speed", "engine_speed", "erpm", "revs", "engine rpm"],
    "MAP": ["map", "manifold absolute pressure", "manifold pressure", "map kpa", "map (kpa)", "manifold_abs_press"],
    "MAF": ["maf", "mass air flow", "mass airflow", "maf g/s", "maf (g/s)", "airflow", "maf lb/min"],
    "TPS": ["tps", "throttle position", "throttle_position", "tps %", "tps (%)", "throttle %", "throttlepos"],
    "STFT_B1": ["stft b1", "stft bank 1", "stft_1", "short term fuel trim bank 1", "stftb1", "left/front int", "left front int", "lf int"],
    "STFT_B2": ["stft b2", "stft bank 2", "stft_2", "short term fuel trim bank 2", "stftb2", "right/rear int", "right rear int", "rr int"],
    "STFT": ["stft", "short term fuel trim", "short_term_fuel_trim", "st fuel trim"],
    "LTFT_B1": ["ltft b1", "ltft bank 1", "ltft_1", "long term fuel trim bank 1", "ltftb1", "left/front blm", "left front blm", "lf blm"],
    "LTFT_B2": ["ltft b2", "ltft bank 2", "ltft_2", "long term fuel trim bank 2", "ltftb2", "right/rear blm", "right rear blm", "rr blm"],
    "LTFT": ["ltft", "long term fuel trim", "long_term_fuel_trim", "lt fuel trim"],
    "BLM_CELL": ["blm cell", "blmcell", "fuel trim cell", "block learn cell"],
    "TCC": ["90 tcc", "tcc", "torque converter clutch", "tcc state", "tcc duty", "tcc solenoid"],
    "SHIFT_TERR_12": ["1 2 shift time error", "shift time error 1 2"],
    "SHIFT_TERR_23": ["2 3 shift time error", "shift time error 2 3"],
    "SHIFT_T12": ["1 2 shift time", "shift time 1 2"],
    "SHIFT_T23": ["2 3 shift time", "shift time 2 3"],
    "KR": ["kr", "knock retard", "knock_retard", "spark retard", "knock retard (deg)", "kr (deg)"],
    "IAT": ["iat", "mat", "manifold air temp", "intake air temp", "intake_air_temp", "iat f", "iat (f)", "air temp"],
    "ECT": ["ect", "coolant", "coolant temp", "engine coolant temp", "coolant_temperature", "ect f", "ect (f)"],
    "CMD_LAMBDA": ["commanded lambda", "commanded_lambda", "commanded afr", "commanded_afr", "eq ratio", "equivalence ratio", "desired afr", "cmd lambda", "target lambda", "target afr", "target air/fuel ratio", "commanded eq", "afr commanded"],
    "WB_LAMBDA": ["wideband", "wideband afr", "wideband_lambda", "wb afr", "wbafr", "wbo2", "wb lambda", "afr wideband", "lambda wideband", "actual afr", "measured afr", "afr (wideband)"],
    "SPARK_ADV": ["spark advance", "spark_advance", "ignition timing", "timing advance", "spark (deg)", "total timing", "sparkadv"],
    "INJ_PW": ["injector pulse width", "inj pw", "injector_pw", "pulse width", "ipw", "injpw ms", "fuel pw"],
    "INJ_DC": ["injector duty cycle", "inj duty cycle", "injector dc", "inj dc"],
    "IAC": ["iac position", "iac steps", "idle air control position", "iac counts"],
    "VSS": ["vss", "vehicle speed", "vehicle_speed", "mph", "kph", "speed"],
    "BARO": ["baro", "barometric", "barometric pressure", "baro kpa", "barometer"],
    "O2_B1": ["o2 b1", "o2 bank 1", "left/front o2", "left front o2", "front o2", "left/front o2 sensor", "o2 sensor bank 1", "lf o2"],
    "O2_B2": ["o2 b2", "o2 bank 2", "right/rear o2", "right rear o2", "rear o2", "right/rear o2 sensor", "o2 sensor bank 2", "rr o2"],
    "O2": ["o2", "o2 sensor", "oxygen sensor", "o2 mv", "o2 (mv)"],
    "TIME": ["=time", "timestamp", "sample time", "log time", "seconds"],
}


def scores(headers: DataFrame) -> DataFrame:
    """The best score of each signal for each header, from 55 on. Rows: log_id, header, header_no."""
    spark = headers.sparkSession
    rows = [(s, k, a.removeprefix("="), a.startswith("=")) for k, (s, names) in enumerate(ALIASES.items()) for a in names]
    alias = F.broadcast(spark.createDataFrame(rows, "signal string, signal_no int, alias string, whole boolean"))
    # a fixed list of some 170 names against distinct headers
    pairs = headers.withColumn("norm", S.normalized_header(F.col("header"))).join(alias, F.lit(True))
    long = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 1)
    mine, theirs = long(F.col("norm")), long(F.col("alias"))
    every = (F.size(theirs) >= 2) & (F.size(F.filter(theirs, lambda w: ~F.array_contains(mine, w))) == 0)
    score = (
        F.when(F.col("norm") == F.col("alias"), 100 + F.least(F.lit(9), F.floor(F.length("alias") / 8)))
        .when(F.col("whole"), 0)
        .when(F.array_contains(F.split("norm", " "), F.col("alias")), 80)
        .when(F.instr(F.col("norm"), F.col("alias")) > 0, 65)
        .when(every, 55)
        .otherwise(0)
    )
    best = pairs.withColumn("score", score.cast("int")).groupBy("log_id", "header", "header_no", "signal", "signal_no").agg(F.max("score").alias("score"))
    return best.where("score >= 55")


def mapped(headers: DataFrame) -> DataFrame:
    """One signal for one header, the best scores first; confidence is high from 80 on."""
    ship_package(headers.sparkSession)

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        taken, used, out = set(), set(), []
        for r in rows.sort_values(["score", "signal_no", "header_no"], ascending=[False, True, True]).itertuples():
            if r.signal not in taken and r.header not in used:
                taken.add(r.signal)
                used.add(r.header)
                out.append((r.log_id, r.signal, r.header, r.score, "high" if r.score >= 80 else "medium"))
        return pd.DataFrame(out, columns=["log_id", "signal", "header", "score", "confidence"])

    id_type = headers.schema["log_id"].dataType.simpleString()
    return scores(headers).groupBy("log_id").applyInPandas(assign, f"log_id {id_type}, signal string, header string, score int, confidence string")


def headers_of(heads: DataFrame) -> DataFrame:
    """The headers of log files (see ``delimited.file_heads``), in order."""
    return heads.select("log_id", F.posexplode("headers").alias("header_no", "header"))
