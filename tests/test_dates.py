from lanternfish.functions import dates


def test_canonical(column):
    raw = ["2026-06-12", "2026-01-01", "January 01, 2026", "Mar 4, 2025", "7/4/25", "07/04/2025", "2025-02-03T10:00:00", "soon", "", None, "2/29/2025"]
    assert column(dates.canonicalize_date, raw) == [
        "2026-06-12", "", "2026-01-01", "2025-03-04", "2025-07-04", "2025-07-04", "2025-02-03", "", "", "", "",
    ]


def test_quality_format(column):
    got = column(dates.normalize_date, ["October 1st, 2025", "2025/3/4", "13/45/2025", "", "1/2/75", "1/2/68"])
    assert [tuple(r) for r in got] == [
        ("2025-10-01", False), ("2025-03-04", False), ("13/45/2025", True), ("", False), ("1975-01-02", False), ("2068-01-02", False),
    ]


def test_lenient(column):
    got = column(lambda c: dates.iso(dates.parse_date_lenient(c)), ["October 2025", "Oct 2025", "2025-1-4", "x"])
    assert got == ["2025-10-01", "2025-10-01", "2025-01-04", None]


def test_month(column):
    got = column(dates.month_of_text, ["sometime in September", "Oct 3rd, 2024", "early JUNE?", "12/1/2024", "none", None])
    assert got == [9, 10, 6, 12, None, None]


def test_timestamps(column):
    show = lambda c: dates.local_timestamp_text(dates.parse_instant(c))
    assert column(show, ["2026-06-29T14:24:10Z", "2026-01-05T00:30:00+00:00", "2026-06-29T14:24:10", "junk"]) == [
        "Jun 29, 2026 at 10:24 AM EDT", "Jan 4, 2026 at 7:30 PM EST", "Jun 29, 2026 at 2:24 PM EDT", None,
    ]
    assert column(dates.public_date, ["2026-06-12", "", None, "last summer"]) == ["Jun 12, 2026", "Unknown", "Unknown", "last summer"]
