from __future__ import annotations

from urlloom.functions.predicates import PREDICATES

CASES = {
    "has_tab_or_newline": (["a\tb", "\r"], ["a b", ""]),
    "is_ascii": (["", "a\x7f"], ["é"]),
    "has_forbidden_host_sign": (["a b", "a%b/", "x|y", "a\x00"], ["a%b", "é", "a\x7f"]),
    "has_forbidden_domain_sign": (["a%b", "é", "a\x7f", "a\x1f"], ["a-b.c", "a{b"]),
    "is_scheme": (["http", "a+b-.9"], ["9a", "", "a_b", "a\n"]),
    "is_digits": (["09"], ["", "9\n", "٣"]),
    "is_hex": (["aF0"], ["g", ""]),
    "ends_in_number": (["1", "a.1", "a.0x", "a.0xff.", "1."], ["a.1x", "a", "0xg", "1..", ""]),
    "is_dotted_quad": (["0.10.255.1"], ["01.1.1.1", "256.1.1.1", "1.1.1", "1.1.1.1."]),
    "is_dot_segment": ([".", "..", "%2e", ".%2E", "%2E%2e"], ["...", "", "a", "%2e%2e%2e"]),
    "is_drive_letter": (["C:", "c|"], ["C", "C:/", "9:", "CC:"]),
}


def test_predicates(spark):
    assert set(CASES) == set(PREDICATES)
    rows = [(n, t, w) for n, (yes, no) in CASES.items() for ts, w in ((yes, True), (no, False), ([None], None)) for t in ts]
    df = spark.createDataFrame(rows, "name string, t string, want boolean")
    for name, f in PREDICATES.items():
        for r in df.where(df.name == name).select("t", "want", f("t").alias("got")).collect():
            assert r.got == r.want, (name, r.t)
