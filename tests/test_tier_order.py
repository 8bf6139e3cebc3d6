"""Intervals of one start go in the order of their tier: the last of them is attached, as the reference does."""

import pytest

from contourlake.operators import region as R
from contourlake.operators import summaries as S
from contourlake.sources import files
from contourlake.sources.adapters import event_intervals

TIER = ("", "t", "a", "n", "")
INTERVAL = '        intervals [{}]:\n            xmin = 5\n            xmax = 5\n            text = "{}"\n'
FILE = 'item []:\n    item [1]:\n        class = "IntervalTier"\n        name = "Rime 1"\n' + "".join(INTERVAL.format(i + 1, x) for i, x in enumerate(TIER))


@pytest.mark.parametrize("source", ["events", "files"])
def test_one_frame_gets_the_last_interval_of_the_tier(spark, frames, source):
    data = frames([("1_click", 5.0, 120.0, "S", "click")])
    iv = event_intervals(data) if source == "events" else files.parse_intervals(spark.createDataFrame([("1_click", FILE)], "token string, content string"))
    for rows in (iv, iv.orderBy("label"), iv.orderBy("label", ascending=False)):
        attached = R.attach_intervals(data, rows, ["Rime 1"])
        assert [(r["rime_1"], r["rime_1_start"], r["rime_1_end"], r["rime_1_i"]) for r in attached.collect()] == [("", 5.0, 5.0, None)]
        assert [R.filter_intervals(attached, "rime_1", mode, ["t", "n"]).count() for mode in ("labels", "vowel", "rhyme")] == [0, 0, 0]
        assert S.part_lines(attached, "rime_1_i").first()["line_group"] == "1_click"
        assert [(r["label"], r["i"]) for r in R.number_intervals(rows).orderBy("place").collect()] == [("", None), ("t", 1), ("a", 2), ("n", 3), ("", None)]
