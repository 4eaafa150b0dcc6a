from pyspark.sql import functions as F

from kavak.llm import neardup
from kavak.llm.neardup import _common, _sets


def test_every_record_counts(spark, monkeypatch):
    """How many records hold a run is exact, also of more records than were once counted in full; and in several lots."""
    n = 20_500
    own = F.concat_ws(" ", *(F.concat(F.lit(f"kelime{k}x"), F.col("id").cast("string")) for k in range(8)))
    few = F.when(F.col("id") % 7 == 0, " altın gümüş bakır").otherwise("")
    text = F.concat(own, F.lit(" bir iki üç"), few)
    rows = spark.range(0, n, 1, 3).select("id", text.alias("text"))
    monkeypatch.setattr(neardup, "COUNTED", 40_000, raising=False)
    runs, held = _common(rows, 3, 50)
    count = dict(zip(runs.tolist(), held.tolist()))
    of = lambda t: int(_sets([t], 3, 0)[1][0]) & (1 << 8 * neardup.RUN_BYTES) - 1
    sevens = len(range(0, n, 7))
    assert sevens % 4 and count == {of("bir iki üç"): n, of("iki üç altın"): sevens, of("üç altın gümüş"): sevens, of("altın gümüş bakır"): sevens}
    assert runs.tolist() == sorted(runs.tolist())
