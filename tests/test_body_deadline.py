import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from eligo.functions.body_deadline import body_deadline

NOW = dt.datetime(2026, 6, 1, 3)


def start(y, m, d):
    return dt.datetime(y, m, d) - dt.timedelta(hours=9)


def end(y, m, d):
    return dt.datetime(y, m, d, 14, 59, 59)


def told(spark, text, posted=None):
    row = spark.createDataFrame([(text, posted, NOW)], "t string, p timestamp_ntz, n timestamp_ntz").select(body_deadline(F.col("t"), F.col("n"), F.col("p")).alias("x")).first().x
    return row and (row.start, row.end)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None),
        ("", None),
        ("  \n ", None),
        ("접수기간은 추후 공고합니다", None),
        ("접수기간 : 2026.03.05 ~ 2026. 7. 20.", (start(2026, 3, 5), end(2026, 7, 20))),
        ("신청·접수기간 2026년 6월 3일 ～ 6월 30일", (start(2026, 6, 3), end(2026, 6, 30))),
        ("모집기간 11월 20일 ~ 1월 9일", (start(2026, 11, 20), end(2027, 1, 9))),
        ("공고일정 : 26-06-02 9시 ~ 26-06-17 18시", (start(2026, 6, 2), end(2026, 6, 17))),
        ("접수기간 2026.6.1~2026.6.9 연장 접수기간 2026.6.1~2026.6.20", (start(2026, 6, 1), end(2026, 6, 20))),
        ("접수기간 2026.6.1~2026.6.20" + "." * 150 + "접수기간 2026.5.1~2026.6.20", (start(2026, 6, 1), end(2026, 6, 20))),
        ("모집기간 2026-05-01 ~ 예산 소진 시까지", (start(2026, 5, 1), None)),
        ("신청기간 상시", (None, None)),
        ("신청기간 상시" + "." * 150 + "접수기간 ~ 2026.7.1", (None, end(2026, 7, 1))),
        ("접수기간 2026.6.9 ~ 2026.6.1", None),
        ("접수기간 2026.2.1 ~ 2026.2.31", None),
        ("접수기간 2022.2.1 ~ 2022.3.1", None),
        ("접수기간 2026.2.1 ~ 2030.3.1", None),
        ("7월 31일까지 제출", (None, end(2026, 7, 31))),
        ("1월 15일까지 제출", (None, end(2027, 1, 15))),
        ("신청마감 2026.9.5 (2026.10.1 발표)", (None, end(2026, 9, 5))),
        ("2026.8.1 발표, 2026.9.2 마감", (None, end(2026, 9, 2))),
        ("2026.8.1마감 2026.9.2", (None, end(2026, 9, 2))),
        ("한도 3.5억원까지, 마감 26.6.20", (None, end(2026, 6, 20))),
        ("한도 3.5억원까지", None),
        ("2026.09.01부터 선착순 마감", (None, None)),
        ("선착순 마감" + "." * 90 + "기한 2026.8.8", (None, end(2026, 8, 8))),
        ("기한 2019.8.8" + "." * 90 + "기한 2026.8.8", (None, end(2026, 8, 8))),
    ],
)
def test_body_deadline(spark, text, want):
    assert told(spark, text) == want


def test_a_day_without_a_year_is_of_the_year_of_the_posting(spark):
    assert told(spark, "7월 31일까지", dt.datetime(2025, 7, 1)) == (None, end(2025, 7, 31))
    assert told(spark, "7월 31일까지", dt.datetime(2013, 7, 1)) is None  # the end is believed by today, not by the posting


def test_evidence_is_one_line_of_eighty_letters(spark):
    text = "앞\n" * 60 + "접수기간 :\n 2026.6.1 \t~ 2026.6.20 " + "뒤 " * 100
    x = spark.createDataFrame([(text, NOW)], "t string, n timestamp_ntz").select(body_deadline(F.col("t"), F.col("n"), F.lit(None).cast("timestamp_ntz")).alias("x")).first().x
    assert x.evidence.startswith("접수기간 : 2026.6.1 ~ 2026.6.20 뒤") and len(x.evidence) == 80


def test_long_texts_take_time_by_their_length(spark):
    text = "접수기간 2026.6.1 ~ 2026.6.20, 한도 3.5억원까지 " * 20_000
    began = time.monotonic()
    assert told(spark, text) == (start(2026, 6, 1), end(2026, 6, 20))
    assert told(spark, "1" * 2_000_000 + " 마감 " * 20_000) is None
    assert time.monotonic() - began < 60
