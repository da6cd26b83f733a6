"""Hand-written DuckDB SQL fragments for the oracle queries.

These restate the corpus views and the cleaning rules in SQL (RE2 regex
dialect), independently of the Spark plans: ``\\w`` is spelled
``[\\p{L}\\p{N}_]`` and Java's Unicode ``\\s`` as ``[\\s\\x{0B}\\x{85}\\p{Z}]``.
"""

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
WS = r"[\s\x{0B}\x{85}\p{Z}]"

POSTS = """posts AS (
  SELECT d.doc_id AS id, d.source, d.lang AS language, d.text,
         CASE WHEN l.toxic IS NULL THEN 'test' ELSE 'train' END AS split,
         CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'non-toxic' END AS task1,
         CASE l.quality * 2 + l.toxic WHEN 0 THEN 'low-clean' WHEN 1 THEN 'low-toxic'
              WHEN 2 THEN 'high-clean' WHEN 3 THEN 'high-toxic' END AS task2
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

DECORATE = ("('RT @u' || ({i} % 7) || ': ' || {t} || ' #Tag' || ({i} % 11) || ' MENTION' || ({i} % 5)"
            " || ' http://x.org/p/' || {i} || '?a=1 ' || chr(128512))")

SOCIAL = POSTS + """,
social AS (SELECT id, source, language, split, task1, task2, """ + DECORATE.format(i="id", t="text") + """ AS text FROM posts)"""

EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
HASHTAG = r"(?ims)(^|" + NW + r")(#" + W + r"+)"
MENTION = r"(?ims)(^|" + NW + r")((rt|ht|cc|[.] ?)?(@" + W + r"+|MENTION\p{Nd}+))"
URL = (r"(http|ftp|https)://([\p{L}\p{N}__-]+(?:(?:\.[\p{L}\p{N}__-]+)+))"
       r"([\p{L}\p{N}_.,@?^=%&:/~+#-]*[\p{L}\p{N}_@?^=%&/~+#-])?")


def strip_emoji(e: str) -> str:
    return f"regexp_replace({e}, '{EMOJI}', '', 'g')"


def strip_hashtags(e: str) -> str:
    return f"regexp_replace({e}, '{HASHTAG}', '\\1', 'g')"


def strip_mentions(e: str) -> str:
    return f"regexp_replace({e}, '{MENTION}', '\\1', 'g')"


def strip_urls(e: str) -> str:
    return f"regexp_replace({e}, '{URL}', '', 'g')"


def normalize_space(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def strip_markup(e: str) -> str:
    t = f"regexp_replace({e}, '(?is)<script\\b[^>]*>.*?</script{WS}*>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<style\\b[^>]*>.*?</style{WS}*>', '', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', '', 'g')"
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©")]:
        t = f"replace({t}, '{ent}', '{ch}')"
    return f"replace({t}, '&amp;', '&')"


def clean_text(e: str, fix_encoding: bool = False) -> str:
    t = strip_markup(e) if fix_encoding else e
    return normalize_space(strip_urls(strip_mentions(strip_hashtags(strip_emoji(t)))))


def clean_text_light(e: str) -> str:
    return normalize_space(strip_urls(e))


def word_tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '{W}{{2,}}')"


def lit_list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in sorted(set(terms))) + "]"


def phash(e: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(CAST({e} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT"


TOKENS = """tokens AS (
  SELECT doc_id, sent_id, i, form, form AS lemma,
         CASE WHEN i = 0 THEN NULL ELSE greatest(0, i - 1 - i % 2) END AS head
  FROM (SELECT doc_id, sent_id, unnest(ws) AS form, unnest(range(len(ws))) AS i
        FROM (SELECT doc_id, s.sent_id, """ + word_tokens("s.sentence") + """ AS ws
              FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?\\n]+')) AS sentence,
                           unnest(range(len(string_split_regex(text, '[.!?\\n]+')))) AS sent_id
                    FROM documents) s)))"""


def mask_terms(e: str, terms) -> str:
    """Whole-word, case-sensitive masking.  RE2 has no Unicode \\b, so the
    neighbours are consumed and put back; two passes cover terms separated
    by a single character."""
    alt = "|".join(sorted(set(terms), key=lambda s: (-len(s), s)))
    pat = f"(^|{NW})({alt})({NW}|$)"
    return f"regexp_replace(regexp_replace({e}, '{pat}', '\\1<MASK>\\3', 'g'), '{pat}', '\\1<MASK>\\3', 'g')"


def reference_items(masked_terms) -> str:
    return f"""reference_items AS (
  SELECT item_id AS id, 'benchmark' AS dataset, text, CAST(-1 AS BIGINT) AS of_id FROM benchmark
  UNION ALL
  SELECT item_id + 1000000 AS id, 'masked' AS dataset, {mask_terms('text', masked_terms)} AS text,
         item_id AS of_id FROM benchmark)"""
