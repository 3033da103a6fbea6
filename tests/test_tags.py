"""Tags of the samples, whatever separates them and whichever sign stands after the name."""

from orestrata.plans import normalization as P

_SAMPLES = [
    ("GSM1", "strain: BC35-/-; passage: p54; Gender: fem"), ("GSM2", "sex = male | tissue: liver"), ("GSM3", "tissue: lung;\tage: 4 weeks;\tsex:female"),
    ("GSM4", 'note: labelled "a; sex: male" at source\nsex: unknown'), ("GSM5", "time: 4:16"), ("GSM6", None), ("GSM7", "sex: "), ("GSM8", "no tag")]


def test_tags_at_all_separators(spark, tmp_path):
    spark.createDataFrame(_SAMPLES, "gsm string, characteristics_ch1 string").write.parquet(f"{tmp_path}/gsm.parquet")
    got = {(r.gsm, r.name, r.value) for r in P._tags(spark, str(tmp_path)).collect()}
    assert {("GSM1", "gender", "fem"), ("GSM1", "passage", "p54"), ("GSM2", "sex", "male"), ("GSM3", "sex", "female"), ("GSM3", "age", "4 weeks"),
            ("GSM4", "sex", "unknown"), ("GSM5", "time", "4:16")} <= got
    assert not [r for r in got if ";" in r[2] and r[0] != "GSM4"] and ("GSM4", "sex", 'male" at source') not in got
    sexes = {r.gsm: (r.ids, r.status) for r in P.sex_fold(spark, str(tmp_path)).collect()}
    assert sexes == {"GSM1": ("PATO:0000383", "mapped"), "GSM2": ("PATO:0000384", "mapped"), "GSM3": ("PATO:0000383", "mapped"), "GSM4": ("", "unknown")}
    assert {(r.field, r.n) for r in P.field_values(spark, str(tmp_path)).collect()} >= {("sex", 4), ("tissue", 2), ("age", 1)}


def test_series_tags_at_all_separators(spark, tmp_path):
    rows = [(1, "tissue: lung\nsex: male"), (2, "tissue: lung\tgender=F\tsex: m"), (3, 'tissue: lung, "sex: female", age: 4 weeks'), (4, "tissue: lung"), (5, None)]
    spark.createDataFrame(rows, "id long, characteristics string").write.parquet(f"{tmp_path}/series.parquet")
    assert {r.id: r.sexes for r in P.tag_split(spark, str(tmp_path)).collect()} == {1: "male", 2: "F|m", 3: "female"}
