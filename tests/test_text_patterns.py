"""Personal data and log lines in the forms that they come in."""

import pytest

from millrace.operators import cleansing, logs


@pytest.mark.parametrize("text, hits", [
    ("(555) 123-4567", (0, 0, 1)), ("+1 555 123 4567", (0, 0, 1)), ("5551234567", (0, 0, 1)), ("1-555-123-4567", (0, 0, 1)), ("555.123.4567 and 555-123-4567", (0, 0, 2)),
    ("12345678901234", (0, 0, 0)), ("123-45-6789", (0, 1, 0)), ("a.b+c@d-e.example, x@y", (1, 0, 0)), ("", (0, 0, 0)), (None, (0, 0, 0)),
])
def test_personal_data(spark, text, hits):
    row = cleansing.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.email, row.ssn, row.phone) == hits and row.status == ("blocked_pii" if any(hits) else "ingested")


LINES = [
    "2024-03-01 10:00:00 [INFO] PRESS-1: temperature 81.5 pressure: 3 speed   120. running",
    "  2024-03-01 10:00:01  [CRITICAL]  PRESS-1:  Line DOWN, maintenance, out of spec  ",
    "2024-03-01 10:00:02 [INFO] PRESS-1: caution: temperature is high",
    "2024-03-01 10:00:03 [INFO] PRESS-1: stopped, back to normal",
    "2024-13-01 10:00:03 [INFO] PRESS-1: no such month",
    "2024-03-01 10:00:04 [INFO] press 1: no such equipment", "noise", "",
]


def test_log_lines(spark):
    rows = logs.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string")).orderBy("ts").collect()
    assert [(r.temperature, r.pressure, r.speed, r.status) for r in rows] == [(81.5, 3.0, 120.0, "operational"), (None, None, None, "down"), (None, None, None, "warning"), (None, None, None, "operational")]


def test_a_line_can_be_several_alerts(spark):
    found = logs.alerts(logs.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string"))).collect()
    assert {(r.alert_type, r.n, r.severity) for r in found} == {("error", 1, "critical"), ("maintenance", 1, "medium"), ("quality", 1, "high")}
