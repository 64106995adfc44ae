"""Driver contract, structured extraction fixtures, SSRF and metrics smoke."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from pagefold.functions.netaddr import is_private_ip
from pagefold.operators import structured as S


def test_entry_and_registry(spark):
    assert E.entry(spark).count() > 0
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs) and len(qs) >= 40


def test_private_ips(spark):
    ips = ["127.0.0.1", "10.2.3.4", "172.16.0.1", "172.31.255.255", "172.32.0.1", "192.168.1.1", "169.254.9.9",
           "::1", "::ffff:10.0.0.1", "0.0.0.0", "fe80::1", "8.8.8.8", "999.1.1.1"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ips], "ip string").select(is_private_ip(F.col("ip"))).collect()]
    assert got == [True, True, True, True, False, True, True, True, True, False, False, False, False]


def test_llm_request_and_parse(spark):
    pages = spark.createDataFrame([(1, "u", "# Hello\n\nWorld", '{"type":"object"}', "get title")],
                                  "job_id long, url string, markdown string, schema string, prompt string")
    r = S.build_requests(pages).collect()[0]
    assert r["user"] == "get title\n\n---\n\n# Hello\n\nWorld" and r["response_format"] == "json_schema"
    assert '"name":"extract"' in r["body"] and '"strict":false' in r["body"]
    resp = spark.createDataFrame([(1, "u", '{"choices":[{"message":{"content":" {\\"title\\":\\"Hello\\"} "}}]}'),
                                  (2, "u", "nope"), (3, "u", '{"error":{"message":"x"}}'), (4, "u", '{"choices":[]}'),
                                  (5, "u", '{"choices":[{"message":{"content":"plain"}}]}')],
                                 "job_id long, url string, body string")
    got = {r["job_id"]: (r["extracted"], r["error"]) for r in S.parse_responses(resp).collect()}
    assert got[1] == ('{"title":"Hello"}', None)
    assert [got[i][1] for i in (2, 3, 4, 5)] == [S.ERR_INVALID, S.ERR_LLM, S.ERR_EMPTY, S.ERR_NON_JSON]


def test_private_addresses_in_any_spelling(spark):
    private = ["::ffff:a00:1", "::ffff:7f00:1", "0::1", "0:0:0:0:0:ffff:0a00:0001", "::FFFF:C0A8:0101", "0:0:0:0:0:0:0:1",
               "0000:0000::0001", "::ffff:169.254.1.1", "::1"]
    public = ["2001:db8::1", "::", "::2", "1::1", "::ffff:808:808", "::a00:1", "::ffff:10.0.0.1.2", ":::1", "1:2:3:4:5:6:7", "::1::",
              "12345::1", "0:0:0:0:0:0:0:0:1", "::ffff:999.1.1.1", "fc00::1", "", "host", None]
    df = spark.createDataFrame([(i,) for i in private + public], "ip string")
    got = [r[0] for r in df.select(is_private_ip(F.col("ip"))).collect()]
    assert got == [True] * len(private) + [False] * len(public)


def test_request_cut_inside_a_character_and_white_space(spark):
    text = "a" + "é" * 60_000
    pages = spark.createDataFrame([(1, "u", text, None, ""), (2, "u", "short", None, "")],
                                  "job_id long, url string, markdown string, schema string, prompt string")
    rows = {r["job_id"]: r for r in S.build_requests(pages, max_markdown_bytes=S.MAX_MARKDOWN_BYTES).collect()}
    assert rows[1]["truncated"] and not rows[2]["truncated"] and rows[2]["user"] == "short"
    assert rows[1]["user"].startswith("a" + "é" * 49_999) and rows[1]["user"][50_000:] == "�"
    whole = S.build_requests(pages).where("job_id = 1").first()
    assert whole["user"] == text and not whole["truncated"]
    resp = spark.createDataFrame([(1, "u", '{"choices":[{"message":{"content":"\\n\\t\\u00a0{\\"t\\":1}\\r\\n"}}]}')],
                                 "job_id long, url string, body string")
    assert S.parse_responses(resp).first()["extracted"] == '{"t":1}'
    blank = spark.createDataFrame([("completed", "x", 1, None, "\n\t ")],
                                  "status string, markdown string, n_pages int, schema string, prompt string")
    assert S.eligibility(blank).first()["reject_reason"] == S.REASON_NEED_INPUT
