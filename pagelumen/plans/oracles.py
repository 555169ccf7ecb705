"""DuckDB SQL for the registered queries, written by hand against the same tables.

The audit's facts, rules and fixed values are stated here a second time, in SQL; nothing is imported from the
code under test, so that a comparison is one of two implementations.
"""

from __future__ import annotations

# Fixed values, written out here a second time.
ENTITIES = [('&lt;', '<'),
 ('&gt;', '>'),
 ('&quot;', '"'),
 ('&#39;', "'"),
 ('&apos;', "'"),
 ('&nbsp;', '\xa0'),
 ('&copy;', '©'),
 ('&middot;', '·'),
 ('&ndash;', '–'),
 ('&mdash;', '—'),
 ('&hellip;', '…'),
 ('&rsquo;', '’'),
 ('&amp;', '&')]
ORDER = ['meta_tags',
 'headings',
 'images',
 'links',
 'performance',
 'mobile',
 'structured_data',
 'sitemap',
 'robots',
 'tracking',
 'semantic',
 'ads_quality',
 'serp_features',
 'accessibility']
WEIGHTS = {'meta_tags': 0.1,
 'performance': 0.09,
 'tracking': 0.07,
 'images': 0.07,
 'links': 0.07,
 'headings': 0.05,
 'mobile': 0.06,
 'semantic': 0.05,
 'structured_data': 0.07,
 'sitemap': 0.05,
 'robots': 0.04,
 'ads_quality': 0.08,
 'serp_features': 0.07,
 'accessibility': 0.13}
RELEVANCE = {'meta_tags': 9,
 'performance': 9,
 'tracking': 8,
 'accessibility': 8,
 'mobile': 7,
 'structured_data': 7,
 'serp_features': 7,
 'images': 6,
 'links': 6,
 'ads_quality': 6,
 'headings': 5,
 'sitemap': 5,
 'semantic': 4,
 'robots': 4}
INDUSTRY_WORDS = {'E-commerce': ['shop', 'store', 'buy now', 'add to cart', 'checkout', 'free shipping', 'product'],
 'Technology': ['software', 'saas', 'api', 'platform', 'developer', 'cloud', 'ai ', 'machine learning'],
 'Healthcare': ['health', 'medical', 'doctor', 'patient', 'clinic', 'hospital', 'wellness'],
 'Finance': ['financial', 'banking', 'investment', 'insurance', 'mortgage', 'loan', 'credit'],
 'Education': ['learn', 'course', 'student', 'university', 'school', 'training', 'certification'],
 'Real Estate': ['real estate', 'property', 'listing', 'apartment', 'rental', 'home for sale'],
 'Food & Beverage': ['restaurant', 'menu', 'delivery', 'food', 'catering', 'dining'],
 'Travel & Hospitality': ['hotel', 'booking', 'travel', 'flight', 'vacation', 'resort'],
 'Legal': ['law firm', 'attorney', 'legal', 'lawyer'],
 'Automotive': ['automotive', 'car dealer', 'vehicle', 'auto repair'],
 'Beauty': ['beauty', 'salon', 'spa', 'skincare', 'cosmetic'],
 'Fitness': ['fitness', 'gym', 'workout', 'training', 'exercise'],
 'Media & Publishing': ['news', 'magazine', 'blog', 'publish', 'editorial'],
 'Non-Profit': ['donate', 'nonprofit', 'charity', 'volunteer', 'foundation'],
 'Professional Services': ['consulting', 'agency', 'marketing agency', 'accounting']}
#: Short name, category, pattern of the id, source parts, inline parts, noscript parts.
VENDORS = [('GTM', 'tag_manager', 'GTM-[A-Z0-9]{4,8}', ['googletagmanager.com/gtm.js'], ['GTM-'], ['googletagmanager.com/ns.html']),
 ('GA4', 'analytics', 'G-[A-Z0-9]{8,12}', ['googletagmanager.com/gtag/js'], ['gtag(', 'G-'], []),
 ('UA', 'analytics', 'UA-\\d{4,10}-\\d{1,4}', ['google-analytics.com/analytics.js'], ['UA-'], []),
 ('GAds', 'advertising', 'AW-\\d{8,12}', ['googleadservices.com'], ['AW-'], []),
 ('FBP', 'advertising', '\\d{15,16}', ['connect.facebook.net'], ['fbq('], []),
 ('TTP', 'advertising', '[A-Z0-9]{18,22}', ['analytics.tiktok.com'], ['ttq.load'], []),
 ('PIN', 'advertising', '\\d{13}', ['s.pinimg.com'], ['pintrk'], []),
 ('SNAP', 'advertising', '[a-f0-9-]{36}', ['sc-static.net/scevent'], ['snaptr('], []),
 ('LI', 'advertising', '\\d{5,8}', ['snap.licdn.com'], ['_linkedin_partner_id'], []),
 ('UET', 'advertising', '\\d{7,9}', ['bat.bing.com'], ['uetq'], []),
 ('CLAR', 'heatmap', '[a-z0-9]{8,12}', ['clarity.ms'], ['clarity('], []),
 ('HJ', 'heatmap', '\\d{6,8}', ['hotjar.com'], ['hj(', '_hjSettings'], []),
 ('SEG', 'analytics', '[a-zA-Z0-9]{20,32}', ['cdn.segment.com'], ['analytics.load'], []),
 ('KLAV', 'crm', '[A-Za-z0-9]{6}', ['static.klaviyo.com'], ['_learnq'], []),
 ('ICOM', 'crm', '[a-z0-9]{8}', ['widget.intercom.io'], ['Intercom('], []),
 ('HEAP', 'analytics', '\\d{8,12}', ['heapanalytics.com'], ['heap.load'], []),
 ('MXP', 'analytics', '[a-f0-9]{32}', ['cdn.mxpnl.com'], ['mixpanel.init'], []),
 ('SHOP', 'analytics', 'trekkie', ['cdn.shopify.com/s/trekkie'], ['ShopifyAnalytics'], []),
 ('LO', 'heatmap', '\\d{5,8}', ['luckyorange.com'], ['__lo_site_id'], [])]
#: Rules that come without advice.
UNADVISED = ['ads_content_ok',
 'ads_no_h1',
 'ads_no_title',
 'ads_no_viewport',
 'ads_not_https',
 'ads_short',
 'ads_thin',
 'alt_empty',
 'alt_ok',
 'blocking_some',
 'canonical_ok',
 'conversion_missing',
 'conversion_ok',
 'cta_missing',
 'cta_ok',
 'description_ok',
 'external_none',
 'features_found',
 'features_none',
 'figures_found',
 'footer_missing',
 'forms_incomplete',
 'ga4_ok',
 'gsc_ok',
 'gtm_ok',
 'h1_ok',
 'header_missing',
 'headings_counted',
 'hierarchy_ok',
 'image_pack_ok',
 'images_none',
 'internal_ok',
 'lists_found',
 'lists_none',
 'main_ok',
 'media_queries_none',
 'media_queries_ok',
 'microdata_missing',
 'nav_ok',
 'page_size_ok',
 'pixel_bing',
 'pixel_clarity',
 'pixel_facebook',
 'pixel_hotjar',
 'pixel_linkedin',
 'pixel_pinterest',
 'pixel_tiktok',
 'ratio_moderate',
 'ratio_ok',
 'roles_none',
 'roles_ok',
 'semantic_none',
 'semantic_ok',
 'sitelinks_ok',
 'times_found',
 'title_ok',
 'viewport_ok']


def _decode(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _visible(x: str) -> str:
    tagless = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({_decode(tagless)}, '\\s+', ' ', 'g'))"


def _attr(tag: str, name: str) -> str:
    """A quoted or bare attribute's value; NULL if the tag hasn't got it."""
    pattern = "(?is)[\\s\"''/]" + name + "\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)"
    bare = "(?is)[\\s\"''/]" + name + "(?:\\s|=|/|>)"
    value = f"regexp_extract({tag}, '{pattern}', 1)"
    return f"CASE WHEN {value} <> '' THEN {_decode(f'''regexp_replace({value}, '(?s)^[\"'']|[\"'']$', '', 'g')''')} WHEN regexp_matches({tag}, '{bare}') THEN '' END"


def _tags(source: str, name: str) -> str:
    return f"regexp_extract_all({source}, '(?is)<(?:{name})\\b[^>]*>')"


def _count(name: str) -> str:
    return f"len(regexp_extract_all(live, '(?i)<{name}(?:\\s|>|/)'))"


_NET = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_SCHEME = "lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_QUERY = "regexp_extract({0}, '^[^?#]*\\?([^#]*)', 1)"


def _bare(u: str) -> str:
    p = f"regexp_replace({_PATH.format(u)}, '/+$', '')"
    return f"CASE WHEN {p} = '' THEN '/' ELSE {p} END"


def _crawl(u: str) -> str:
    q = _QUERY.format(u)
    return f"{_SCHEME.format(u)} || '://' || {_NET.format(u)} || ({_bare(u)}) || (CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def _export(u: str) -> str:
    return f"{_SCHEME.format(u)} || '://' || lower({_NET.format(u)}) || ({_bare(u)})"


_LINKS = """list_transform(hrefs, lambda h: trim(coalesce(h, '')))"""

FACTS = f"""
base AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS markup,
    regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g') AS prose
  FROM pages),
bodies AS (
  SELECT *, regexp_replace(markup, '(?is)(<script\\b[^>]*>).*?(</script\\s*>)|(<style\\b[^>]*>).*?(</style\\s*>)', '\\1\\2\\3\\4', 'g') AS live,
    regexp_extract_all(markup, '(?is)<script\\b[^>]*>.*?</script\\s*>') AS scripts
  FROM base),
extracts AS (
  SELECT *,
    {_SCHEME.format('url')} AS scheme, {_NET.format('url')} AS host,
    CASE WHEN regexp_matches(markup, '(?is)<title\\b[^>]*>.*?</title\\s*>') THEN {_visible("regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title', 1)")} END AS title,
    list_filter({_tags('live', 'meta')}, lambda t: coalesce({_attr('t', 'name')}, '') = 'description') AS descriptions,
    list_filter({_tags('live', 'meta')}, lambda t: coalesce({_attr('t', 'name')}, '') = 'viewport') AS viewports,
    len(list_filter({_tags('live', 'meta')}, lambda t: coalesce({_attr('t', 'property')}, '') LIKE 'og:%')) AS og_tags,
    len(list_filter({_tags('live', 'meta')}, lambda t: coalesce({_attr('t', 'name')}, '') LIKE 'twitter:%')) > 0 AS twitter,
    len(list_filter({_tags('live', 'meta')}, lambda t: coalesce({_attr('t', 'name')}, '') = 'google-site-verification')) > 0 AS gsc,
    len(list_filter({_tags('live', 'link')}, lambda t: lower(coalesce({_attr('t', 'rel')}, '')) = 'canonical')) > 0 AS canonical,
    {_attr(f"coalesce({_tags('markup', 'html')}[1], '')", 'lang')} AS lang,
    regexp_extract_all(live, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]\\s*>') AS headings,
    {_tags('live', 'img')} AS imgs,
    list_transform({_tags('live', 'a')}, lambda t: {_attr('t', 'href')}) AS hrefs,
    list_transform({_tags('live', 'a')}, lambda t: list_contains(string_split(lower(coalesce({_attr('t', 'rel')}, '')), ' '), 'nofollow')) AS nofollows,
    list_filter(list_transform(scripts, lambda s: {_attr("regexp_extract(s, '(?is)^(<script[^>]*>)', 1)", 'src')}), lambda s: s IS NOT NULL) AS sources,
    list_filter(scripts, lambda s: {_attr("regexp_extract(s, '(?is)^(<script[^>]*>)', 1)", 'src')} IS NULL) AS inlines,
    len(list_filter(scripts, lambda s: lower(coalesce({_attr("regexp_extract(s, '(?is)^(<script[^>]*>)', 1)", 'type')}, '')) = 'application/ld+json')) > 0 AS jsonld,
    {_visible("regexp_extract(prose, '(?is)<body[^>]*>(.*)', 1)")} AS body_text,
    regexp_matches(prose, '(?i)<body\\b') AS has_body,
    {_visible('prose')} AS doc_text,
    len(list_filter({_tags("regexp_extract(markup, '(?is)<nav[^>]*>(.*?)</nav', 1)", 'a')}, lambda t: {_attr('t', 'href')} IS NOT NULL)) AS nav_links,
    len(list_filter(regexp_extract_all(markup, '(?is)<style\\b[^>]*>.*?</style\\s*>'), lambda s: contains(s, '@media'))) > 0 AS media,
    len(regexp_extract_all(live, '(?is)<[a-z][^>]*\\srole\\s*=\\s*["'']?(?:banner|navigation|main|contentinfo)["''\\s>]')) > 0 AS has_roles
  FROM bodies),
facts AS (
  SELECT *, length(coalesce(title, '')) AS tl, length(html) AS hl, len(array_to_string(inlines, ' ')) AS il,
    length(trim(coalesce({_attr('descriptions[1]', 'content')}, ''))) AS dl,
    strlen(html) / 1024.0 AS kb,
    len(list_filter(headings, lambda h: regexp_matches(h, '(?i)^<h1'))) AS h1s,
    len(list_filter(headings, lambda h: regexp_matches(h, '(?i)^<h2'))) AS h2s,
    len(list_filter(headings, lambda h: regexp_matches(h, '(?i)^<h3'))) AS h3s,
    len(list_filter(headings, lambda h: regexp_matches(h, '(?i)^<h4'))) AS h4s,
    len(list_filter(headings, lambda h: regexp_matches(h, '(?i)^<h5'))) AS h5s,
    len(list_filter(headings, lambda h: regexp_matches(h, '(?i)^<h6'))) AS h6s,
    length({_visible("coalesce(list_filter(headings, lambda h: regexp_matches(h, '(?i)^<h1'))[1], '')")}) AS h1l,
    list_sort(list_distinct(list_transform(headings, lambda h: substring(h, 3, 1)::INT))) AS levels,
    len(list_filter(imgs, lambda t: {_attr('t', 'alt')} IS NULL)) AS no_alt,
    len(list_filter(imgs, lambda t: trim(coalesce({_attr('t', 'alt')}, 'x')) = '')) AS empty_alt,
    len(list_filter(imgs, lambda t: trim(coalesce({_attr('t', 'alt')}, '')) <> '')) AS good_alt,
    len(list_filter(imgs, lambda t: coalesce({_attr('t', 'width')}, '') = '' OR coalesce({_attr('t', 'height')}, '') = '')) AS no_size,
    len(list_filter(imgs, lambda t: lower(coalesce({_attr('t', 'loading')}, '')) <> 'lazy')) AS eager,
    len(imgs) AS n_imgs, len(hrefs) AS n_links,
    len(list_filter({_LINKS}, lambda h: h = '' OR h = '#' OR h LIKE 'javascript:%')) AS bad_links,
    len(list_filter({_LINKS}, lambda h: NOT (h = '' OR h = '#' OR h LIKE 'javascript:%') AND {_NET.format('h')} NOT IN ('', host))) AS ext_links,
    len(list_filter({_LINKS}, lambda h: NOT (h = '' OR h = '#' OR h LIKE 'javascript:%') AND {_NET.format('h')} IN ('', host))) AS int_links,
    len(list_filter(hrefs, lambda h: h IS NOT NULL)) AS href_links,
    len(list_filter(nofollows, lambda b: b)) AS nofollow_links,
    len(list_filter(scripts, lambda s: coalesce({_attr("regexp_extract(s, '(?is)^(<script[^>]*>)', 1)", 'src')}, '') <> '' AND NOT regexp_matches(s, '(?is)^<script[^>]*\\s(?:async|defer)(?:\\s|=|>)'))) AS blocking,
    CASE WHEN body_text = '' THEN 0 ELSE len(string_split(body_text, ' ')) END AS words,
    CASE WHEN doc_text = '' THEN 0 ELSE len(string_split(doc_text, ' ')) END AS doc_words,
    CASE WHEN has_body AND length(html) > 0 THEN round_even(length(body_text) / length(html) * 100, 1) ELSE 0.0 END AS ratio,
    {', '.join(f'{_count(t)} AS n_{t}' for t in ('header', 'nav', 'main', 'article', 'section', 'aside', 'footer', 'ul', 'ol', 'figure', 'time', 'form', 'label'))},
    array_to_string(inlines, ' ') AS inline_text,
    regexp_matches(html, 'UA-\\d{{4,10}}-\\d{{1,4}}') AS ua,
    len(list_filter(sources, lambda s: contains(s, 'gtm.js') OR contains(s, 'googletagmanager.com'))) > 0 OR regexp_matches(html, 'GTM-[A-Z0-9]+') AS gtm,
    (contains(array_to_string(inlines, ' '), 'gtag(') AND contains(array_to_string(inlines, ' '), 'G-')) OR len(list_filter(sources, lambda s: contains(s, 'googletagmanager.com/gtag'))) > 0 AS ga4,
    {', '.join(f"(len(list_filter(sources, lambda s: contains(s, '{a}'))) > 0 OR contains(array_to_string(inlines, ' '), '{b}')) AS px_{n}" for n, a, b in (('facebook', 'connect.facebook.net', 'fbq('), ('linkedin', 'snap.licdn.com', '_linkedin_partner_id'), ('tiktok', 'analytics.tiktok.com', 'ttq.load'), ('pinterest', 's.pinimg.com', 'pintrk'), ('bing', 'bat.bing.com', 'bat.bing.com'), ('hotjar', 'hotjar.com', 'hotjar.com'), ('clarity', 'clarity.ms', 'clarity.ms')))},
    regexp_matches(html, '(?i)gtag\\(|googletagmanager\\.com|google-analytics\\.com|GA1\\.|gtm\\.js|GTM-[A-Z0-9]+|googleads\\.g\\.doubleclick\\.net|AW-[0-9]+|conversion\\.js|fbq\\(|connect\\.facebook\\.net/.*fbevents') AS converts,
    len(list_filter(regexp_extract_all(live, '(?is)<(?:a|button)\\b[^>]*>([^<]*)</(?:a|button)\\s*>', 1), lambda t: regexp_matches(t, '(?i)\\b(buy\\s*now|add\\s*to\\s*cart|shop\\s*now|sign\\s*up|get\\s*started|subscribe|learn\\s*more|contact\\s*us|request\\s*a?\\s*quote|book\\s*now|order\\s*now|free\\s*trial|download|register)\\b'))) AS ctas
  FROM extracts)"""

_GAPS = "len(list_filter(list_zip(levels, levels[2:]), lambda p: p[2] - p[1] > 1))"
_ANY_PIXEL = "(px_facebook OR px_linkedin OR px_tiktok OR px_pinterest OR px_bing OR px_hotjar OR px_clarity)"
_FEATURES = "((nav_links >= 4 AND href_links >= 10)::INT + (good_alt >= 3)::INT)"
# Category, rule, severity, impact, condition, penalty. The driver's pages have no JSON-LD, microdata, submit button,
# robots meta or measured time; queries over pages with added markup cover the first two.
RULES = [
    ("meta_tags", "title_missing", "error", "high", "tl = 0", "25"),
    ("meta_tags", "title_short", "warning", "medium", "tl BETWEEN 1 AND 29", "10"),
    ("meta_tags", "title_long", "warning", "medium", "tl > 60", "10"),
    ("meta_tags", "title_ok", "pass", None, "tl BETWEEN 30 AND 60", "0"),
    ("meta_tags", "description_missing", "error", "high", "dl = 0", "20"),
    ("meta_tags", "description_short", "warning", "medium", "dl BETWEEN 1 AND 119", "10"),
    ("meta_tags", "description_long", "warning", "low", "dl > 160", "5"),
    ("meta_tags", "description_ok", "pass", None, "dl BETWEEN 120 AND 160", "0"),
    ("meta_tags", "canonical_missing", "warning", "medium", "NOT canonical", "10"),
    ("meta_tags", "canonical_ok", "pass", None, "canonical", "0"),
    ("meta_tags", "og_incomplete", "warning", "medium", "og_tags = 0", "15"),
    ("meta_tags", "twitter_missing", "info", "low", "NOT twitter", "5"),
    ("meta_tags", "lang_missing", "warning", "medium", "trim(coalesce(lang, '')) = ''", "5"),
    ("headings", "h1_missing", "error", "high", "h1s = 0", "30"),
    ("headings", "h1_several", "warning", "medium", "h1s > 1", "15"),
    ("headings", "h1_empty", "error", "high", "h1s = 1 AND h1l = 0", "20"),
    ("headings", "h1_long", "warning", "low", "h1s = 1 AND h1l > 70", "10"),
    ("headings", "h1_ok", "pass", None, "h1s = 1 AND h1l BETWEEN 1 AND 70", "0"),
    ("headings", "level_skipped", "warning", "medium", f"{_GAPS} > 0", "10"),
    ("headings", "level_skipped_again", "warning", "medium", f"{_GAPS} > 1", "10"),
    ("headings", "hierarchy_ok", "pass", None, f"{_GAPS} = 0 AND len(levels) > 1", "0"),
    ("headings", "headings_missing", "error", "high", "len(headings) = 0", "20"),
    ("headings", "headings_counted", "info", None, "len(headings) > 0", "0"),
    ("images", "images_none", "info", None, "n_imgs = 0", "0"),
    ("images", "alt_missing", "error", "high", "no_alt > 0", "least(40, 5 * no_alt)"),
    ("images", "alt_empty", "info", "low", "empty_alt > 0", "0"),
    ("images", "alt_ok", "pass", None, "n_imgs > 0 AND no_alt = 0", "0"),
    ("images", "size_missing", "warning", "medium", "no_size > 0", "least(20, 3 * no_size)"),
    ("images", "lazy_missing", "warning", "medium", "n_imgs > 3 AND eager > 3", "10"),
    ("links", "href_empty", "warning", "medium", "bad_links > 0", "least(15, 3 * bad_links)"),
    ("links", "nofollow_internal", "warning", "medium", "nofollow_links > 0", "least(15, 5 * nofollow_links)"),
    ("links", "internal_none", "error", "high", "int_links = 0 AND n_links > 0", "20"),
    ("links", "internal_ok", "pass", None, "int_links > 0", "0"),
    ("links", "external_none", "info", "low", "ext_links = 0 AND n_links > 5", "0"),
    ("performance", "page_very_large", "error", "high", "kb > 3000", "25"),
    ("performance", "page_large", "warning", "medium", "kb > 1500 AND kb <= 3000", "10"),
    ("performance", "page_size_ok", "pass", None, "kb <= 1500", "0"),
    ("performance", "not_https", "error", "high", "scheme <> 'https'", "20"),
    ("performance", "blocking_many", "warning", "medium", "blocking > 3", "10"),
    ("performance", "blocking_some", "info", "low", "blocking BETWEEN 1 AND 3", "0"),
    ("mobile", "viewport_missing", "error", "high", "len(viewports) = 0", "40"),
    ("mobile", "viewport_ok", "pass", None, "len(viewports) > 0", "0"),
    ("mobile", "media_queries_ok", "pass", None, "media", "0"),
    ("mobile", "media_queries_none", "info", "low", "NOT media", "0"),
    ("structured_data", "jsonld_missing", "warning", "high", "NOT jsonld", "25"),
    ("structured_data", "microdata_missing", "warning", "medium", "NOT jsonld", "10"),
    ("structured_data", "structured_none", "error", "high", "NOT jsonld", "15"),
    ("tracking", "gsc_missing", "error", "high", "NOT gsc", "25"),
    ("tracking", "gsc_ok", "pass", None, "gsc", "0"),
    ("tracking", "ga4_ok", "pass", None, "ga4", "0"),
    ("tracking", "ua_legacy", "warning", "medium", "NOT ga4 AND ua", "0"),
    ("tracking", "gtm_ok", "pass", None, "gtm", "0"),
    ("tracking", "gtm_missing", "warning", "medium", "NOT gtm", "15"),
    *(("tracking", f"pixel_{p}", "info", None, f"px_{p}", "0") for p in ("facebook", "linkedin", "tiktok", "pinterest", "bing", "hotjar", "clarity")),
    ("tracking", "nothing_measures", "error", "high", f"NOT ga4 AND NOT ua AND NOT {_ANY_PIXEL}", "30"),
    ("tracking", "analytics_missing", "warning", "medium", f"NOT ga4 AND NOT ua AND {_ANY_PIXEL}", "15"),
    ("semantic", "semantic_ok", "pass", None, "n_header + n_nav + n_main + n_article + n_section + n_aside + n_footer > 0", "0"),
    ("semantic", "semantic_none", "error", "high", "n_header + n_nav + n_main + n_article + n_section + n_aside + n_footer = 0", "0"),
    ("semantic", "main_missing", "error", "high", "n_main = 0", "20"),
    ("semantic", "main_ok", "pass", None, "n_main = 1", "0"),
    ("semantic", "main_several", "warning", "medium", "n_main > 1", "10"),
    ("semantic", "nav_missing", "warning", "medium", "n_nav = 0", "15"),
    ("semantic", "nav_ok", "pass", None, "n_nav > 0", "0"),
    ("semantic", "header_missing", "warning", "low", "n_header = 0", "10"),
    ("semantic", "footer_missing", "warning", "low", "n_footer = 0", "10"),
    ("semantic", "roles_ok", "pass", None, "has_roles", "0"),
    ("semantic", "roles_none", "info", "low", "NOT has_roles", "0"),
    ("semantic", "ratio_ok", "pass", None, "has_body AND hl > 0 AND ratio >= 25", "0"),
    ("semantic", "ratio_moderate", "info", None, "has_body AND hl > 0 AND ratio >= 10 AND ratio < 25", "0"),
    ("semantic", "ratio_low", "warning", "medium", "has_body AND hl > 0 AND ratio < 10", "15"),
    ("semantic", "lists_found", "info", None, "n_ul + n_ol > 0", "0"),
    ("semantic", "lists_none", "info", None, "n_ul + n_ol = 0", "0"),
    ("semantic", "figures_found", "info", None, "n_figure > 0", "0"),
    ("semantic", "times_found", "info", None, "n_time > 0", "0"),
    ("ads_quality", "ads_not_https", "error", "high", "scheme <> 'https'", "15"),
    ("ads_quality", "ads_no_viewport", "error", "high", "len(viewports) = 0", "15"),
    ("ads_quality", "ads_thin", "warning", "medium", "words < 100", "10"),
    ("ads_quality", "ads_short", "info", "low", "words BETWEEN 100 AND 299", "3"),
    ("ads_quality", "ads_content_ok", "pass", None, "words >= 300", "0"),
    ("ads_quality", "ads_no_title", "warning", "medium", "tl = 0", "5"),
    ("ads_quality", "ads_no_h1", "info", "low", "tl > 0 AND h1s = 0", "2"),
    ("ads_quality", "conversion_missing", "warning", "medium", "NOT converts", "10"),
    ("ads_quality", "conversion_ok", "pass", None, "converts", "0"),
    ("ads_quality", "cta_missing", "warning", "medium", "ctas = 0", "5"),
    ("ads_quality", "cta_ok", "pass", None, "ctas > 0", "0"),
    ("ads_quality", "forms_incomplete", "info", None, "n_form > 0", "0"),
    ("serp_features", "features_found", "pass", None, f"{_FEATURES} > 0", "0"),
    ("serp_features", "features_none", "warning", "medium", f"{_FEATURES} = 0", "0"),
    ("serp_features", "sitelinks_ok", "pass", None, "nav_links >= 4 AND href_links >= 10", "0"),
    ("serp_features", "image_pack_ok", "pass", None, "good_alt >= 3", "0"),
]
SCORED = [c for c in ORDER if any(r[0] == c for r in RULES)]
_START = {"serp_features": f"floor({_FEATURES} / 8.0 * 100)::INT"}


def _score(category: str) -> str:
    losses = " - ".join(f"(CASE WHEN {when} THEN {loss} ELSE 0 END)" for c, _, _, _, when, loss in RULES if c == category and loss != "0")
    return f"least(100, greatest(0, {_START.get(category, '100')}{' - ' + losses if losses else ''}))::INT"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in (FACTS, *ctes))


def _chained(*ctes: str) -> str:
    """The facts of pages that link to the next page of their host."""
    chain = f"""chained AS (SELECT page_id, url, coalesce(html, '') || coalesce('<a href="' || replace(lead(url) OVER (PARTITION BY lower({_NET.format('url')}) ORDER BY page_id), '&', '&amp;') || '">next</a>', '') AS html FROM pages)"""
    return "WITH RECURSIVE " + ",\n".join([chain, *(c.strip() for c in (FACTS.replace("FROM pages)", "FROM chained)"), *ctes))])


# What the markup that is added to pages should give, worked out by hand from the rules: by the remainder of page_id
# by 8 (structured data, paths) or by 4 (tags).
_MARKED = "marked AS (SELECT page_id, " + _SCHEME.format("url") + " || '://' || " + _NET.format("url") + " AS root, lower(" + _NET.format("url") + ") AS site, page_id % 8 AS e, page_id % 4 AS t FROM pages WHERE regexp_matches(url, '^https?://[^/?#]'))"
_PATHS = "(VALUES (0, 'collection', 0), (1, 'homepage', 0), (2, 'product', 0), (3, 'cart', 0), (4, 'blog', 1), (5, 'page', 1), (6, 'collection', 1)) k(e, page_type, place)"
_ENTITIES = """(VALUES (0, 'json-ld', 0, 'Product', true, 'description_missing'), (1, 'json-ld', 0, 'Recipe', true, 'description_missing'), (1, 'json-ld', 1, 'FAQPage', true, 'name_missing,description_missing'),
  (2, 'json-ld', 0, NULL, false, 'jsonld_unreadable'), (3, 'json-ld', 0, 'Gadget', false, 'context_missing,type_unknown'),
  (3, 'json-ld', 1, 'Article', true, 'context_missing,property_unknown,name_missing,description_missing'), (4, 'microdata', 0, 'Person', true, 'property_unknown,name_missing,description_missing'),
  (5, 'rdfa', 0, 'Event', true, 'name_missing,description_missing'), (6, 'json-ld', 0, NULL, false, 'type_missing'), (7, 'json-ld', 0, 'BreadcrumbList', true, 'name_missing')) k(e, source, position, entity_type, valid, issues)"""
_MARKED_TAGS = """(VALUES (0, 'GTM', 'tag_manager', 'src', 'GTM-ABC123', 'GTM*******', false, 'low'), (1, 'FBP', 'advertising', 'src', '123456789012345', '1234***********', true, 'medium'),
  (2, 'GA4', 'analytics', 'inline', 'G-ABCDEFGH12', 'G-A*********', false, 'low'), (3, 'GTM', 'tag_manager', 'noscript', 'GTM-XYZ789', 'GTM*******', false, 'low')) k(t, vendor_short, category, method, own, masked, blocking, load_impact)"""
_PRICED = "priced AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders)"
_SPEED = "speed AS (SELECT o_orderkey, n, trunc(((n % 101) / 100.0::DOUBLE) * 100)::INT AS score, (n % 6000)::DOUBLE AS lcp, (n % 50) / 100.0::DOUBLE AS cls, (n % 1000)::DOUBLE AS tbt, (n % 900 + 301)::DOUBLE AS save FROM priced)"

_WIDE = "wide AS (SELECT page_id, url, " + ", ".join(f"{_score(c)} AS {c}" for c in SCORED) + " FROM facts)"
_OVERALL = (
    "overall AS (SELECT page_id, url, round_even(("
    + " + ".join(f"{c} * {WEIGHTS[c]}::DOUBLE" for c in SCORED)
    + ") / ("
    + " + ".join(f"{WEIGHTS[c]}::DOUBLE" for c in SCORED)
    + "), 0)::INT AS overall_score FROM wide)"
)
_LONG = "long AS (SELECT page_id, url, unnest([" + ", ".join(f"{{'category': '{c}', 'position': {ORDER.index(c)}, 'score': {c}}}" for c in SCORED) + "], recursive := true) FROM wide)"


def _issue_list() -> str:
    rows = []
    for i, (c, rule, severity, impact, when, _) in enumerate(RULES):
        shown = "NULL::VARCHAR" if impact is None else f"'{impact}'"
        advice = "false" if rule in UNADVISED else "true"
        rows.append(f"{{'category': '{c}', 'cpos': {ORDER.index(c)}, 'ipos': {i}, 'rule_id': '{rule}', 'severity': '{severity}', 'impact': {shown}, 'advice': {advice}, 'there': {when}}}")
    return "[" + ", ".join(rows) + "]"


_PRIORITY = (
    "(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) * 4 + (CASE impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) * 2 + (CASE category "
    + " ".join(f"WHEN '{c}' THEN {r}" for c, r in RELEVANCE.items())
    + " ELSE 3 END) * 0.5::DOUBLE"
)
_ISSUES = f"every AS (SELECT page_id, url, unnest({_issue_list()}, recursive := true) FROM facts),\nissues AS (SELECT *, {_PRIORITY} AS priority FROM every WHERE there)"
_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, cpos, ipos) AS rank FROM issues WHERE severity <> 'pass')"

_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in ("error", "warning", "info", "pass"))


def _folder(u: str) -> str:
    f = f"regexp_extract({_PATH.format(u)}, '^(.*/)', 1)"
    return f"CASE WHEN {f} = '' THEN '/' ELSE {f} END"


# Addresses in the driver's pages have no dot segments.
_EDGES = f"""anchored AS (SELECT DISTINCT url, trim(unnest(list_transform({_tags('prose', 'a')}, lambda t: {_attr('t', 'href')}))) AS href FROM base WHERE {_NET.format('url')} <> ''),
targets AS (SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN {_SCHEME.format('url')} || ':' || href
  WHEN href LIKE '/%' THEN {_SCHEME.format('url')} || '://' || {_NET.format('url')} || href WHEN href LIKE '?%' THEN {_SCHEME.format('url')} || '://' || {_NET.format('url')} || {_PATH.format('url')} || href
  ELSE {_SCHEME.format('url')} || '://' || {_NET.format('url')} || ({_folder('url')}) || href END AS target FROM anchored WHERE href IS NOT NULL AND href <> '' AND href NOT LIKE '#%'),
edges AS (SELECT DISTINCT {_crawl('url')} AS src, {_crawl('target')} AS dst, {_NET.format('target')} = {_NET.format('url')} AS internal FROM targets WHERE regexp_matches(target, '(?i)^https?://[^/?#]'))"""
_WALK = f"""starts AS (SELECT {_crawl('arg_min(url, page_id)')} AS node FROM pages GROUP BY lower({_NET.format('url')})),
walk AS (SELECT DISTINCT node, 0 AS depth FROM starts UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node AND e.internal AND e.src <> e.dst WHERE w.depth < 400),
met AS (SELECT page_id, url, node, depth FROM (SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node) JOIN pages ON {_crawl('url')} = node)"""
# The same to any level: a level holds only nodes that none before has, so it ends with the last node that is reached, whatever circles there are.
_WHOLE_WALK = f"""starts AS (SELECT {_crawl('arg_min(url, page_id)')} AS node FROM pages GROUP BY lower({_NET.format('url')})),
nodes AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS n FROM (SELECT DISTINCT {_crawl('url')} AS node FROM pages)),
links AS MATERIALIZED (SELECT DISTINCT a.n AS a, b.n AS b FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE internal AND a.n <> b.n),
steps(n, depth) USING KEY (n) AS (SELECT n, 0 FROM nodes WHERE node IN (SELECT node FROM starts)
  UNION SELECT DISTINCT l.b, s.depth + 1 FROM steps s JOIN links l ON l.a = s.n LEFT JOIN recurring.steps r ON r.n = l.b WHERE r.n IS NULL),
met AS (SELECT page_id, url, node, depth FROM steps JOIN nodes USING (n) JOIN pages ON {_crawl('url')} = node)"""
_PROBE = "(CASE length(dst) % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 301 WHEN 3 THEN 500 ELSE 0 END)"
_AUDITS = "audits AS (SELECT o_custkey AS brand_id, o_orderkey AS audit_id, o_orderdate AS created_at, floor(o_totalprice % 101)::INT AS overall_score FROM orders)"
_IDEAS = "ideas AS (SELECT p_name AS keyword, p_brand AS brand, floor(p_retailprice)::BIGINT AS avg_monthly_searches, p_size AS competition_index FROM part)"


def _grade(s: str) -> str:
    return f"CASE WHEN {s} >= 90 THEN 'A' WHEN {s} >= 80 THEN 'B+' WHEN {s} >= 70 THEN 'B' WHEN {s} >= 60 THEN 'C' WHEN {s} >= 50 THEN 'D' ELSE 'F' END"


def _band(s: str) -> str:
    return f"CASE WHEN {s} >= 80 THEN 'good' WHEN {s} >= 50 THEN 'fair' ELSE 'poor' END"


def _industry(text: str) -> str:
    head = f"lower(substring({text}, 1, 5000))"
    votes = [f"{{'n': -({' + '.join(f'contains({head}, {chr(39)}{w}{chr(39)})::INT' for w in ws)}), 'i': {i}, 'name': '{name}'}}" for i, (name, ws) in enumerate(INDUSTRY_WORDS.items())]
    return f"(CASE WHEN list_sort([{', '.join(votes)}])[1].n <= -2 THEN list_sort([{', '.join(votes)}])[1].name END)"


def _tag_list() -> str:
    rows = []
    for short, kind, pattern, sources, inline, nos in VENDORS:
        by_source = " OR ".join(f"contains(s, '{p}')" for p in sources)
        by_inline = " OR ".join(f"contains(inline_nl, '{p}')" for p in inline)
        by_nos = " OR ".join(f"contains(noscript, '{p}')" for p in nos) or "false"
        found = f"regexp_extract(array_to_string(sources, chr(10)) || chr(10) || inline_nl || chr(10) || noscript, '({pattern})', 1)"
        method = f"CASE WHEN len(list_filter(sources, lambda s: {by_source})) > 0 THEN 'src' WHEN {by_inline} THEN 'inline' WHEN {by_nos} THEN 'noscript' END"
        rows.append(f"{{'vendor_short': '{short}', 'category': '{kind}', 'method': {method}, 'raw_id': CASE WHEN {found} <> '' THEN {found} END}}")
    return "[" + ", ".join(rows) + "]"


_TAGS = f"""tagged AS (SELECT *, array_to_string(list_transform(inlines, lambda s: regexp_extract(s, '(?is)^<script[^>]*>(.*)</script\\s*>$', 1)), chr(10)) AS inline_nl,
  array_to_string(regexp_extract_all(markup, '(?is)<noscript\\b[^>]*>(.*?)</noscript\\s*>', 1), chr(10)) AS noscript FROM extracts),
listed_tags AS (SELECT page_id, url, unnest({_tag_list()}, recursive := true) FROM tagged),
found_tags AS (SELECT page_id, url, vendor_short, category, method, CASE WHEN raw_id IS NOT NULL THEN substring(raw_id, 1, greatest(1, floor(length(raw_id) * 0.3)::INT)) || repeat('*', length(raw_id) - greatest(1, floor(length(raw_id) * 0.3)::INT)) END AS tag_id FROM listed_tags WHERE method IS NOT NULL)"""

ORACLES: dict[str, str] = {
    "page_title_facts": _with() + "\nSELECT page_id, title, length(title) AS title_length, lang FROM facts",
    "url_parts": f"SELECT page_id, {_SCHEME.format('url')} AS scheme, {_NET.format('url')} AS netloc, {_PATH.format('url')} AS path, {_QUERY.format('url')} AS query, {_SCHEME.format('url')} || '://' || {_NET.format('url')} AS base_url FROM pages",
    "url_normalized": f"SELECT page_id, {_crawl('url')} AS crawl_url, {_export('url')} AS export_url, regexp_replace(lower(regexp_replace({_NET.format('url')}, ':\\d*$', '')), '^www\\.', '') AS domain, {_NET.format('url')} = 'localhost' AS private_host FROM pages",
    "heading_counts": _with() + "\nSELECT page_id, " + ", ".join(f"h{i}s::INT AS h{i}_count" for i in range(1, 7)) + " FROM facts",
    "link_profile": _with() + "\nSELECT page_id, n_links::INT AS total_links, int_links::INT AS internal_links, ext_links::INT AS external_links, nofollow_links::INT AS nofollow_links, bad_links::INT AS empty_links FROM facts",
    "link_edges": _with(_EDGES) + "\nSELECT src, dst, internal FROM edges",
    "link_degrees": _with(_EDGES) + "\nSELECT node, sum(o)::BIGINT AS out_links, sum(i)::BIGINT AS in_links FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node",
    "text_stats": _with() + "\nSELECT page_id, length(body_text)::INT AS text_length, words::INT AS body_words, doc_words::INT AS document_words, hl::INT AS html_length FROM facts",
    **{f"{c}_score": _with() + f"\nSELECT page_id, {_score(c)} AS score FROM facts" for c in SCORED},
    "tracking_flags": _with() + "\nSELECT page_id, gsc, ga4, ua, gtm, px_facebook AS facebook, px_linkedin AS linkedin, px_tiktok AS tiktok, px_pinterest AS pinterest, px_bing AS bing, px_hotjar AS hotjar, px_clarity AS clarity FROM facts",
    "overall_score": _with(_WIDE, _OVERALL) + "\nSELECT page_id, url, overall_score FROM overall",
    "score_bands": _with(_WIDE, _OVERALL)
    + f"\nSELECT page_id, {_band('overall_score')} AS band, {_grade('overall_score')} AS grade, CASE WHEN overall_score >= 80 THEN 'strong' WHEN overall_score >= 60 THEN 'solid' ELSE 'needs_work' END AS closing, CASE WHEN overall_score < 50 THEN 'large_gains' WHEN overall_score < 80 THEN 'steady_gains' ELSE 'fine_tuning' END AS outcome FROM overall",
    "category_scores_long": _with(_WIDE, _LONG) + "\nSELECT page_id, category, position, score, 'ok' AS status FROM long",
    "category_severities": _with(_ISSUES) + f"\nSELECT category, {_COUNTS} FROM issues GROUP BY category",
    "issue_rules": _with(_ISSUES) + "\nSELECT category, rule_id, severity, count(*) AS n FROM issues GROUP BY ALL",
    "severity_shares": _with(_ISSUES) + "\nSELECT page_id, floor(count(*) FILTER (severity = 'error') * 100 / count(*))::INT AS pct_error, floor(count(*) FILTER (severity = 'warning') * 100 / count(*))::INT AS pct_warning FROM issues GROUP BY page_id",
    "worst_severity": _with(_ISSUES) + "\nSELECT page_id, category, arg_max(severity, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS worst FROM issues GROUP BY ALL",
    "recommendations_by_impact": _with(_ISSUES) + "\nSELECT coalesce(impact, 'none') AS impact, count(*) AS n FROM issues WHERE advice GROUP BY 1",
    "top_opportunities": _with(_ISSUES, _TOP) + "\nSELECT page_id, rank, category, rule_id, severity, impact, priority FROM top WHERE rank <= 8",
    "immediate_fixes": _with(_ISSUES) + "\nSELECT page_id, rank, category, rule_id, severity, impact, priority FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, cpos, ipos) AS rank FROM issues) WHERE rank <= 5 AND severity IN ('error', 'warning')",
    "quick_wins_top3": _with(_ISSUES) + "\nSELECT page_id, category, rank, rule_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY page_id, category ORDER BY priority DESC, ipos) AS rank FROM issues WHERE severity <> 'pass') WHERE rank <= 3",
    "numbered_errors": _with(_ISSUES)
    + "\nSELECT page_id, category, rule_id, row_number() OVER (PARTITION BY page_id ORDER BY (CASE category "
    + " ".join(f"WHEN '{c}' THEN {w}" for c, w in WEIGHTS.items())
    + " END) DESC, cpos, ipos) AS number FROM issues WHERE severity = 'error'",
    "issue_page": _with(_ISSUES) + "\nSELECT page_id, category, rule_id, severity FROM issues ORDER BY (CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END), page_id, cpos, ipos LIMIT 50 OFFSET 100",
    "weakest_categories": _with(_WIDE, _LONG) + "\nSELECT page_id, rank, category, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score, position) AS rank FROM long) WHERE rank <= 3",
    "narrative_variant": _with(_ISSUES) + "\nSELECT page_id, errors, warnings, CASE WHEN errors > 5 THEN 'many_errors' WHEN errors > 0 THEN 'some_errors' ELSE 'no_errors' END AS variant FROM (SELECT page_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY page_id)",
    "host_rollup": _with(_WIDE, _OVERALL) + f"\nSELECT lower({_NET.format('url')}) AS host, count(*) AS pages, min(overall_score) AS min_score, max(overall_score) AS max_score, floor(avg(overall_score))::INT AS mean_score FROM overall GROUP BY 1",
    "rollup_host_category": _with(_WIDE, _LONG) + f"\nSELECT host, category, count(*) AS n, floor(avg(score))::INT AS mean_score FROM (SELECT lower({_NET.format('url')}) AS host, category, score FROM long) GROUP BY ROLLUP (host, category)",
    "duplicate_titles": _with() + "\nSELECT title AS value, count(*) AS n, min(url) AS first_url FROM facts WHERE coalesce(title, '') <> '' GROUP BY title HAVING count(*) > 1",
    "duplicate_descriptions": _with() + f"\nSELECT value, count(*) AS n, min(url) AS first_url FROM (SELECT url, {_attr('descriptions[1]', 'content')} AS value FROM facts) WHERE coalesce(value, '') <> '' GROUP BY value HAVING count(*) > 1",
    "orphan_pages": _with(_EDGES) + f"\nSELECT page_id, url FROM pages WHERE {_crawl('url')} NOT IN (SELECT dst FROM edges)",
    "broken_internal_links": _with(_EDGES) + f"\nSELECT src, dst, {_PROBE} AS code FROM edges WHERE internal AND dst NOT IN (SELECT {_crawl('url')} FROM pages) AND {_PROBE} IN (0, 404, 500)",
    "crawl_report": _chained(
        _EDGES,
        _WHOLE_WALK,
        f"""counts AS (SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM edges WHERE dst NOT IN (SELECT {_crawl('url')} FROM pages) AND {_PROBE} IN (0, 404, 500)) AS broken,
  (SELECT count(*) FROM pages WHERE {_crawl('url')} NOT IN (SELECT dst FROM edges)) AS orphans, (SELECT count(*) FROM (SELECT title FROM facts WHERE coalesce(title, '') <> '' GROUP BY title HAVING count(*) > 1)) AS duplicate_titles,
  0::BIGINT AS duplicate_descriptions, (SELECT max(depth) FROM met) AS max_depth)""",
    )
    + "\nSELECT *, greatest(0, 100 - least(30, 5 * broken) - least(15, 3 * orphans) - least(20, 5 * duplicate_titles) - least(15, 3 * duplicate_descriptions) - (CASE WHEN max_depth > 5 THEN 15 ELSE 0 END))::INT AS score FROM counts",
    "crawl_order": _chained(_EDGES, _WALK) + f"\nSELECT page_id, url, depth FROM met QUALIFY row_number() OVER (PARTITION BY lower({_NET.format('url')}) ORDER BY depth, node, page_id) <= 3",
    "bfs_depth": """WITH RECURSIVE links AS (
  SELECT DISTINCT 'customer/' || o_custkey AS src, 'order/' || o_orderkey AS dst FROM orders
  UNION SELECT 'order/' || l_orderkey, 'part/' || l_partkey FROM lineitem UNION SELECT 'part/' || l_partkey, 'supplier/' || l_suppkey FROM lineitem),
walk AS (SELECT node, 0 AS depth FROM (VALUES ('customer/1'), ('customer/4')) t(node) UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN links l ON l.src = w.node)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""",
    "type_closure": """WITH RECURSIVE own AS (SELECT DISTINCT p_size::VARCHAR AS type, p_type AS property FROM part),
up AS (SELECT DISTINCT p_size::VARCHAR AS type, (p_size // 2)::VARCHAR AS parent FROM part WHERE p_size > 1),
reach AS (SELECT type, parent FROM up UNION SELECT r.type, u.parent FROM reach r JOIN up u ON u.type = r.parent)
SELECT type, property FROM own UNION SELECT r.type, o.property FROM reach r JOIN own o ON o.type = r.parent""",
    "score_history_delta": f"WITH {_AUDITS} SELECT brand_id, audit_id, overall_score, overall_score - lead(overall_score) OVER (PARTITION BY brand_id ORDER BY created_at DESC, audit_id DESC) AS delta FROM audits",
    "brand_overview": f"WITH {_AUDITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY created_at DESC, audit_id DESC) AS n FROM audits), per AS (SELECT brand_id, count(*) AS audits, max(overall_score) FILTER (n = 1) AS latest_score, max(overall_score) FILTER (n = 2) AS previous_score FROM ranked GROUP BY brand_id) SELECT *, latest_score - previous_score AS delta, CASE sign(latest_score - previous_score) WHEN 1 THEN 'up' WHEN -1 THEN 'down' WHEN 0 THEN 'flat' END AS trend FROM per",
    "recent_audits": f"WITH {_AUDITS} SELECT audit_id, brand_id, overall_score FROM audits ORDER BY created_at DESC, audit_id LIMIT 50",
    "position_buckets": "SELECT f.l_returnflag, b.bucket, count(l.q) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (VALUES ('1-3', -1000000, 3), ('4-10', 3, 10), ('11-20', 10, 20), ('21-100', 20, 100)) b(bucket, lo, hi) LEFT JOIN (SELECT l_returnflag, l_quantity::INT AS q FROM lineitem) l ON l.l_returnflag = f.l_returnflag AND l.q > b.lo AND l.q <= b.hi GROUP BY ALL",
    "referring_domains": f"SELECT host, count(*) AS backlinks FROM (SELECT lower(regexp_replace({_NET.format('url')}, ':\\d*$', '')) AS host FROM pages) WHERE host <> '' GROUP BY host ORDER BY backlinks DESC, host LIMIT 10",
    "keyword_summary": f"WITH {_IDEAS} SELECT brand, count(*) AS ideas, round_even(avg(avg_monthly_searches), 0)::BIGINT AS avg_volume, max(avg_monthly_searches) AS max_volume, round_even(avg(competition_index), 0)::BIGINT AS avg_competition FROM ideas GROUP BY brand",
    "top_keywords": f"WITH {_IDEAS} SELECT keyword, brand, avg_monthly_searches, competition_index FROM ideas ORDER BY avg_monthly_searches DESC, keyword, brand, competition_index LIMIT 10",
    "scalar_formats": f"""WITH o AS (SELECT *, floor(o_totalprice)::BIGINT AS n, floor(o_totalprice / 100)::BIGINT AS secs, (floor(o_totalprice)::BIGINT * 1000 + 5000) // 10000 AS cents FROM orders)
SELECT o_orderkey, substring(o_orderpriority, 1, greatest(1, floor(length(o_orderpriority) * 0.3)::INT)) || repeat('*', length(o_orderpriority) - greatest(1, floor(length(o_orderpriority) * 0.3)::INT)) AS redacted,
  (secs // 60) || 'm ' || (secs % 60) || 's' AS duration, {_band('n % 101')} AS band, {_grade('n % 101')} AS grade, (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'major' WHEN 'O' THEN 'moderate' ELSE 'minor' END AS impact_class, o_orderstatus || '_' || substring(sha256(o_orderpriority), 1, 12) || '.png' AS upload FROM o""",
    "industry_votes": f"SELECT doc_id, {_industry('text')} AS industry FROM documents",
    "tag_scan": _with(_TAGS) + "\nSELECT page_id, vendor_short, category, method, tag_id FROM found_tags",
    "tag_coverage": _with(_TAGS) + "\nSELECT p.page_id, count(t.vendor_short)::BIGINT AS tags, coalesce(bool_or(t.vendor_short = 'GTM'), false) AS has_gtm, coalesce(bool_or(t.vendor_short = 'GA4'), false) AS has_ga4, coalesce(bool_or(t.vendor_short = 'FBP'), false) AS has_fbp, coalesce(string_agg(DISTINCT t.vendor_short, ', ' ORDER BY t.vendor_short) FILTER (t.vendor_short NOT IN ('GTM', 'GA4', 'FBP')), '') AS others FROM pages p LEFT JOIN found_tags t USING (page_id) GROUP BY p.page_id",
    "tag_recommendations": _with(_TAGS, f"sites AS (SELECT lower({_NET.format('url')}) AS site, count(*) AS total FROM pages GROUP BY 1), have AS (SELECT lower({_NET.format('url')}) AS site, bool_or(vendor_short = 'GTM') AS gtm, bool_or(vendor_short = 'GA4') AS ga4, bool_or(vendor_short = 'UA') AS ua FROM found_tags GROUP BY 1), joined AS (SELECT site, coalesce(gtm, false) AS gtm, coalesce(ga4, false) AS ga4, coalesce(ua, false) AS ua FROM sites LEFT JOIN have USING (site))")
    + "\nSELECT site, 'tag_manager_missing' AS rule_id, 'High' AS severity, '' AS detail FROM joined WHERE NOT gtm UNION ALL SELECT site, 'analytics_missing', 'Critical', '' FROM joined WHERE NOT ga4 AND NOT ua UNION ALL SELECT site, 'legacy_analytics', 'Medium', '' FROM joined WHERE ua",
    "homepage_enrichment": _with() + f"\nSELECT page_id, substring(coalesce(nullif(trim({_attr('descriptions[1]', 'content')}), ''), nullif(title, '')), 1, 500) AS description, {_industry('body_text')} AS industry, NULL::VARCHAR AS keywords, NULL::VARCHAR AS theme_color, NULL::VARCHAR AS favicon FROM facts",
    "page_types": f"WITH {_MARKED} SELECT site, page_type, page_id FROM marked JOIN {_PATHS} USING (e) QUALIFY row_number() OVER (PARTITION BY site, page_type ORDER BY place, page_id) = 1",
    "schema_entities": f"WITH {_MARKED} SELECT page_id, source, position, entity_type, valid, issues FROM marked JOIN {_ENTITIES} USING (e)",
    "schema_metrics": f"""WITH {_MARKED} SELECT page_id, count(*) AS entities, count(*) FILTER (source = 'json-ld') AS jsonld_entities, count(*) FILTER (source = 'microdata') AS microdata_entities, count(*) FILTER (source = 'rdfa') AS rdfa_entities,
  count(*) FILTER (issues LIKE '%unreadable%') AS syntax_errors, count(*) FILTER (issues LIKE '%type_%') AS type_errors, count(*) FILTER (issues LIKE '%property_unknown%') AS property_warnings, (100 * count(*) FILTER (valid) // count(*))::INT AS valid_entities_pct
  FROM marked JOIN {_ENTITIES} USING (e) GROUP BY page_id""",
    "marked_structured_score": f"WITH {_MARKED} SELECT page_id, score, has_jsonld, has_microdata, has_rdfa, rich_snippet_eligible FROM marked JOIN (VALUES (0, 100, true, false, false, true), (1, 85, true, false, false, false), (2, 50, false, false, false, false), (3, 85, true, false, false, false), (4, 75, false, true, false, false), (5, 50, false, false, true, false), (6, 100, true, false, false, false), (7, 100, true, false, false, true)) k(e, score, has_jsonld, has_microdata, has_rdfa, rich_snippet_eligible) USING (e)",
    "marked_tag_scan": f"WITH {_MARKED} SELECT page_id, vendor_short, category, method, 'body' AS location, masked AS tag_id, blocking, load_impact FROM marked JOIN {_MARKED_TAGS} USING (t)",
    "tag_inventory": f"WITH {_MARKED} SELECT vendor_short, own AS tag_id, count(DISTINCT page_id) AS page_count, min(root || ['/collections/', '/', '/products/p', '/cart', '/blogs/news', '/pages/contact', '/collections/all', '/other'][e + 1]) AS first_url FROM marked JOIN {_MARKED_TAGS} USING (t) GROUP BY ALL",
    "marked_tag_recommendations": f"""WITH {_MARKED}, s AS (SELECT site, count(*) AS total, bool_or(t IN (0, 3)) AS gtm, bool_or(t = 2) AS ga4, bool_or(t = 1) AS pixel, bool_or(e = 1) AS home, count(*) FILTER (t = 1) AS pixels FROM marked GROUP BY site)
SELECT site, 'tag_manager_missing' AS rule_id, 'High' AS severity, '' AS detail FROM s WHERE NOT gtm UNION ALL SELECT site, 'analytics_missing', 'Critical', '' FROM s WHERE NOT ga4 UNION ALL SELECT site, 'blocking_tags', 'High', 'FBP' FROM s WHERE pixel
UNION ALL SELECT site, 'direct_beside_manager', 'Medium', 'FBP' FROM s WHERE gtm AND pixel UNION ALL SELECT site, 'coverage_gap', 'Critical', 'FBP' FROM s WHERE home AND pixels < total AND total > 1""",
    "fetched_pages": "SELECT page_id, status_code, content_type FROM (SELECT page_id, [200, 404, NULL, 301, 500][page_id % 5 + 1] AS status_code, ['text/html; charset=utf-8', 'application/pdf', NULL][page_id % 3 + 1] AS content_type FROM pages) WHERE coalesce(status_code, 0) < 400 AND coalesce(content_type, 'text/html') <> 'application/pdf'",
    "traffic_metrics": f"""WITH {_PRICED}, v AS (SELECT o_orderkey, n // 100 * 100 + 20 AS v, n % 1000 AS k FROM priced)
SELECT o_orderkey, v::DOUBLE AS visits, CASE WHEN v >= 1000000 THEN printf('%.1fM', v / 1000000.0) WHEN v >= 1000 THEN printf('%.1fK', v / 1000.0) ELSE v::VARCHAR END AS visits_display, nullif(k, 0)::DOUBLE AS visit_seconds,
  CASE WHEN k > 0 THEN (k // 60) || 'm ' || (k % 60) || 's' END AS visit_display, 0.25::DOUBLE AS bounce_rate, '25.0%' AS bounce_display, 2.5::DOUBLE AS pages_per_visit, 'direct=0.5,email=0.125' AS channels FROM v""",
    "pagespeed_metrics": f"WITH {_PRICED}, {_SPEED} SELECT o_orderkey, score, lcp AS lcp_ms, cls, tbt AS tbt_ms, 'a,b' AS opportunities, 'c' AS diagnostics FROM speed",
    "pagespeed_issues": f"""WITH {_PRICED}, {_SPEED}
SELECT o_orderkey, 'psi_score' AS rule_id, CASE WHEN score >= 90 THEN 'pass' WHEN score >= 50 THEN 'warning' ELSE 'error' END AS severity, CASE WHEN score >= 90 THEN NULL WHEN score >= 50 THEN 'medium' ELSE 'high' END AS impact, score::DOUBLE AS value FROM speed
UNION ALL SELECT o_orderkey, 'lcp', CASE WHEN lcp > 4000 THEN 'error' ELSE 'warning' END, CASE WHEN lcp > 4000 THEN 'high' ELSE 'medium' END, lcp FROM speed WHERE lcp > 2500
UNION ALL SELECT o_orderkey, 'cls', CASE WHEN cls > 0.25 THEN 'error' ELSE 'warning' END, CASE WHEN cls > 0.25 THEN 'high' ELSE 'medium' END, cls FROM speed WHERE cls > 0.1
UNION ALL SELECT o_orderkey, 'tbt', 'error', 'high', tbt FROM speed WHERE tbt > 600
UNION ALL SELECT o_orderkey, 'a', 'info', CASE WHEN save > 500 THEN 'medium' ELSE 'low' END, save FROM speed UNION ALL SELECT o_orderkey, 'b', 'info', 'low', 300 FROM speed""",
    "accessibility_scores": "SELECT page_id, CASE WHEN page_id % 10 <> 0 THEN (100 - least(40, 3 * (page_id % 17)) - least(20, 2 * (page_id % 13)) - least(15, page_id % 19))::INT END AS score FROM pages",
    "search_report": "SELECT p_partkey, p_name AS keyword, p_size AS position, 'https://s.test/' || p_partkey AS url, p_partkey * 10 AS volume, 0.25::DOUBLE AS traffic_share FROM part WHERE p_partkey % 10 <> 0",
    "advised_issues": _with(_ISSUES) + "\nSELECT category, rule_id, count(*) AS n FROM issues WHERE advice GROUP BY ALL",
    "heaviest_categories": _with(_WIDE, _LONG) + "\nSELECT page_id, category, (CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in WEIGHTS.items()) + " END)::DOUBLE AS weight FROM long",
    "brand_texts": """SELECT c_custkey, c_mktsegment AS industry, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS persona, CASE WHEN c_custkey % 2 = 0 THEN '1M-10M' END AS revenue_range,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN substring(repeat(c_name, 40), 1, 500) ELSE c_name END AS description, 'a|' || c_name AS competitors,
  CASE WHEN c_custkey % 4 = 1 THEN substring(repeat(c_name, 40), 1, 200) WHEN c_custkey % 8 = 0 THEN 'Comprehensive SEO audit and growth analysis.' WHEN c_custkey % 4 = 0 THEN c_name || ' \u2014 SEO audit and growth analysis.' ELSE c_name END AS one_liner FROM customer""",
    "report_texts": """SELECT p_partkey, p_name || ' - ''a'' "b"... - -><-vx ? \u00e9' AS printed, CASE WHEN p_partkey = 0 THEN '7' WHEN p_partkey >= 1000 THEN printf('%.1fB', (p_partkey * 1000130 + 7) / 1000000000.0) ELSE printf('%.1fM', (p_partkey * 1000130 + 7) / 1000000.0) END AS number FROM part""",
    "sitemap_summary": _with(f"u AS (SELECT {_export('url')} AS norm, min(page_id) AS page_id FROM pages GROUP BY 1)", "seen AS (SELECT u.norm, f.title, f.h1s FROM u JOIN facts f USING (page_id))")
    + f"\nSELECT count(*) AS total_urls, count(*) AS status_200, 0::BIGINT AS errors, count(*) FILTER (coalesce(title, '') = '') AS missing_title, count(*) AS missing_description, count(*) FILTER (h1s = 0) AS missing_h1, 0::BIGINT AS noindex, count(*) FILTER (NOT ({_PATH.format('norm')} LIKE '/de/%' OR {_PATH.format('norm')} LIKE '/es/1%')) AS indexable FROM seen",
    "robots_scores": f"SELECT page_id, 100 - (CASE WHEN {_PATH.format('url')} LIKE '/de/%' OR {_PATH.format('url')} LIKE '/es/1*%' THEN 25 ELSE 0 END) AS score FROM pages",
    "robots_rules": f"SELECT base_url, line, 'disallow' AS kind, path FROM (SELECT DISTINCT {_SCHEME.format('url')} || '://' || {_NET.format('url')} AS base_url FROM pages) CROSS JOIN (VALUES (2, '/de/'), (3, '/es/1*')) r(line, path)",
    "sitemap_scores": "SELECT page_id, 90 AS score FROM pages",
    "sitemap_inventory": f"WITH u AS (SELECT DISTINCT {_export('url')} AS norm FROM pages) SELECT norm, 200 AS status_code, 'missing' AS canonical_status, CASE WHEN {_PATH.format('norm')} LIKE '/de/%' OR {_PATH.format('norm')} LIKE '/es/1%' THEN 'No' ELSE 'Yes' END AS indexable, {_PATH.format('norm')} LIKE '/de/%' OR {_PATH.format('norm')} LIKE '/es/1%' AS disallowed FROM u",
}


_BASE = f"{_SCHEME.format('url')} || '://' || {_NET.format('url')}"
_AMP = "replace(url, '&', '&amp;')"
ORACLES["crawl_queue"] = f"""WITH RECURSIVE own AS (SELECT arg_min(url, page_id) AS url, min(page_id) AS page_id FROM pages WHERE regexp_matches(url, '^https?://[^/?#]') GROUP BY {_crawl('url')}),
numbered AS (SELECT *, lower({_NET.format('url')}) AS site, row_number() OVER (PARTITION BY lower({_NET.format('url')}) ORDER BY page_id) - 1 AS n FROM own),
walk AS (SELECT site, n, 0 AS depth, []::INT[] AS path, [n] AS met FROM numbered WHERE n = 0
  UNION ALL SELECT w.site, t.n, depth + 1, list_append(path, k.place), list_append(met, t.n)
  FROM walk w, (VALUES (0), (1), (2)) k(place), numbered t WHERE t.site = w.site AND t.n = CASE k.place WHEN 0 THEN 2 * w.n + 2 WHEN 1 THEN 2 * w.n + 1 ELSE floor((w.n - 1) / 2)::BIGINT END AND NOT list_contains(met, t.n)),
once AS (SELECT site, n, min(struct_pack(depth := depth, path := path)) AS w FROM walk GROUP BY site, n)
SELECT page_id, url, w.depth AS depth, row_number() OVER (PARTITION BY site ORDER BY w) AS number FROM once JOIN numbered USING (site, n) QUALIFY number <= 7"""
ORACLES["sitemap_walk"] = f"""WITH listed AS (SELECT {_BASE} AS base, url, page_id, ['/maps/0.xml', '/maps/1.xml.gz', '/maps/2.xml'][page_id % 3 + 1] AS place, {_export('url')} AS norm FROM pages WHERE regexp_matches(url, '^https?://[^/?#]'))
SELECT base || '/sitemap.xml' AS root, base || m.place AS sitemap, m.url AS url, '2020-01-01' AS lastmod, norm
FROM (SELECT base, norm, min(struct_pack(depth := CASE place WHEN '/maps/0.xml' THEN 1 ELSE 2 END, place := place, page_id := page_id, url := url)) AS m FROM listed GROUP BY base, norm)"""
ORACLES["robots_bans"] = f"""WITH rules AS (SELECT DISTINCT {_BASE} AS base, left({_PATH.format('url')}, page_id % 7 + 3) AS prefix FROM pages WHERE page_id % 5 = 0)
SELECT page_id, count(prefix) > 0 AS disallowed, arg_max(prefix, length(prefix)) AS banned_by FROM pages LEFT JOIN rules ON base = {_BASE} AND starts_with({_PATH.format('url')}, prefix) GROUP BY page_id"""
_LISTED = f"u AS (SELECT {_export('url')} AS norm, arg_min(url, {_AMP}) AS listed, min(page_id) AS page_id FROM pages GROUP BY 1)"
_SHEET = f"""sheet AS (SELECT listed, coalesce(substring(title, 1, 500), '') AS title, length(title) AS tl, {_visible("coalesce(list_filter(headings, lambda h: regexp_matches(h, '(?i)^<h1'))[1], '')")} AS h1, h1s, doc_words,
  {_PATH.format('listed')} LIKE '/de/%' OR {_PATH.format('listed')} LIKE '/es/1%' AS banned FROM u JOIN facts f USING (page_id))"""
ORACLES["sitemap_url_sheet"] = (
    _with(_LISTED, _SHEET)
    + """
SELECT listed AS "URL", 200 AS "Status Code", '' AS "Content-Type", title AS "Page Title", tl AS "Title Length", '' AS "Meta Description", NULL::INT AS "Description Length", h1 AS "H1 Text", '' AS "Canonical URL", 'missing' AS "Canonical Match", '' AS "Robots Meta",
  CASE WHEN banned THEN 'No' ELSE 'Yes' END AS "Is Indexable", CASE WHEN banned THEN 'Disallowed' ELSE 'Allowed' END AS "Robots.txt Status", '2020-01-01' AS "Lastmod", '' AS "Changefreq", '' AS "Priority", doc_words AS "Word Count", '' AS "OG Title", '' AS "OG Description",
  'html_parse' AS "Extraction Method", concat_ws(', ', CASE WHEN title = '' THEN 'Missing title' END, 'Missing description', CASE WHEN h1s = 0 THEN 'Missing H1' END, 'Missing canonical') AS "Notes", '' AS "Error" FROM sheet"""
)
ORACLES["sitemap_summary_sheet"] = (
    _with(_LISTED, _SHEET, "n AS (SELECT count(*) AS n, count(*) FILTER (title = '') AS t, count(*) FILTER (h1 = '') AS h, count(*) FILTER (banned) AS b, coalesce(floor(avg(doc_words) FILTER (doc_words > 0)), 0)::BIGINT AS w FROM sheet)")
    + """
SELECT unnest(range(15))::INT AS place, unnest(['Domain', 'Export Date', 'Total URLs', 'URLs Fetched Successfully', 'URLs Failed', 'HTTP 200', 'HTTP 301/302', 'HTTP 404', 'HTTP 5xx', 'Missing Title', 'Missing Description', 'Missing H1', 'Missing Canonical', 'Non-Indexable', 'Avg Word Count']) AS "Metric",
  unnest(['all sites', '2024-01-01T00:00:00+00:00', n::VARCHAR, n::VARCHAR, '0', n::VARCHAR, '0', '0', '0', t::VARCHAR, n::VARCHAR, h::VARCHAR, n::VARCHAR, b::VARCHAR, w::VARCHAR]) AS "Value" FROM n"""
)
_KINDS = f"kinds AS (SELECT page_id, page_type FROM marked JOIN {_PATHS} USING (e) QUALIFY row_number() OVER (PARTITION BY site, page_type ORDER BY place, page_id) = 1)"
_NAMED = "(VALUES ('GTM', 'Google Tag Manager'), ('FBP', 'Meta Pixel'), ('GA4', 'Google Analytics 4')) v(vendor_short, vendor)"
_SCRIPT = "CASE t WHEN 0 THEN 'https://www.googletagmanager.com/gtm.js?id=GTM*******' WHEN 1 THEN 'https://connect.facebook.net/en_US/fbevents.js' ELSE '' END"
ORACLES["tag_sheet"] = f"""WITH {_MARKED}, {_KINDS}, g AS (SELECT vendor_short, masked, min(category) AS category, count(DISTINCT page_id) AS n, string_agg(DISTINCT coalesce(page_type, 'other'), ', ' ORDER BY coalesce(page_type, 'other')) AS pages_on, arg_min(method, page_id) AS method, arg_min(t, page_id) AS t, arg_min(blocking, page_id) AS blocking, arg_min(load_impact, page_id) AS load_impact
  FROM marked JOIN {_MARKED_TAGS} USING (t) LEFT JOIN kinds USING (page_id) GROUP BY vendor_short, masked)
SELECT vendor AS "Vendor", vendor_short AS "Vendor Short", category AS "Category", masked AS "Tag ID", pages_on AS "Pages Found On", n AS "Page Count", method AS "Load Method", 'body' AS "DOM Location", {_SCRIPT} AS "Script URL", '[REDACTED]' AS "Code Snippet",
  CASE WHEN blocking THEN 'blocking' WHEN method = 'src' THEN 'async or defer' ELSE 'N/A' END AS "Async/Defer", 'No' AS "Duplicate?", load_impact AS "Impact", CASE WHEN blocking THEN 'Blocks rendering' ELSE '' END AS "Impact Detail", '' AS "Notes" FROM g JOIN {_NAMED} USING (vendor_short)"""
ORACLES["tag_advice_sheet"] = f"""SELECT site, severity AS "Priority", topic AS "Category", advice AS "Recommendation", detail AS "Affected Tags", gain AS "Expected Impact" FROM ({ORACLES['marked_tag_recommendations']})
JOIN (VALUES ('tag_manager_missing', 'Tag management', 'Load tags through a tag manager.', 'Tags can be changed without releases'), ('analytics_missing', 'Analytics', 'Measure visits.', 'Decisions on data'), ('blocking_tags', 'Performance', 'Load these tags asynchronously.', 'Pages render sooner'),
  ('direct_beside_manager', 'Tag management', 'Move these tags into the tag manager.', 'One place for all tags'), ('coverage_gap', 'Coverage', 'Put this tag on all pages.', 'Conversions are attributed')) a(rule_id, topic, advice, gain) USING (rule_id)"""
ORACLES["tag_coverage_sheet"] = f"""WITH {_MARKED}, {_KINDS} SELECT page_type AS "Page Type", root || ['/collections/', '/', '/products/p', '/cart', '/blogs/news', '/pages/contact', '/collections/all', '/other'][e + 1] AS "URL", 'scanned' AS "Status", 1::BIGINT AS "Tags Found",
  CASE WHEN t IN (0, 3) THEN 'Yes' ELSE 'No' END AS "GTM", CASE WHEN t = 2 THEN 'Yes' ELSE 'No' END AS "GA4", CASE WHEN t = 1 THEN 'Yes' ELSE 'No' END AS "Meta Pixel", '' AS "Other Tags" FROM marked JOIN kinds USING (page_id)"""
ORACLES["top_issues"] = _with(_ISSUES) + "\nSELECT page_id, rank, category, rule_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY severity, cpos, ipos) AS rank FROM issues WHERE severity IN ('error', 'warning')) WHERE rank <= 8"
ORACLES["stored_overview"] = f"""WITH {_AUDITS}, scored AS (SELECT brand_id, created_at, audit_id, CASE WHEN audit_id % 3 = 0 THEN 100 - overall_score ELSE overall_score END AS score FROM audits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY created_at DESC, audit_id DESC) AS n FROM scored), per AS (SELECT brand_id, count(*) AS audits, max(score) FILTER (n = 1) AS latest_score, max(score) FILTER (n = 2) AS previous_score FROM ranked GROUP BY brand_id)
SELECT *, latest_score - previous_score AS delta, CASE sign(latest_score - previous_score) WHEN 1 THEN 'up' WHEN -1 THEN 'down' WHEN 0 THEN 'flat' END AS trend FROM per"""
ORACLES["schema_kinds"] = f"""WITH {_MARKED} SELECT page_id, entity_type, true AS valid, issues FROM marked JOIN (VALUES (0, 'CreativeWork', 'property_unknown=isbn'), (1, 'JobPosting', 'property_unknown=salary;name_missing=;description_missing='),
  (2, 'Book', 'property_unknown=color, pages;description_missing='), (3, 'Course', ''), (4, 'SoftwareApplication', 'description_missing='), (5, 'MedicalCondition', 'property_unknown=cure')) k(kind, entity_type, issues) ON kind = page_id % 6"""

_TIMED = "timed AS (SELECT *, page_id % 4 = 0 AS broken, (page_id % 4000)::INT AS ms FROM facts)"
_SLOW = "CASE WHEN ms > 3000 THEN 25 WHEN ms > 1500 THEN 15 WHEN ms > 800 THEN 5 ELSE 0 END"
_WAIT = "CASE WHEN ms >= 3000 THEN 15 WHEN ms >= 1000 THEN 5 ELSE 0 END"
_FAILED = "'The category could not be evaluated on this page.'"
ORACLES["contained_failures"] = (
    _with(_TIMED)
    + f"""
SELECT page_id, 'performance' AS category, CASE WHEN broken THEN 0 ELSE greatest(0, {_score('performance')} - ({_SLOW})) END::INT AS score, CASE WHEN broken THEN 'error' ELSE 'ok' END AS status, CASE WHEN broken THEN {_FAILED} END AS error_message FROM timed
UNION ALL SELECT page_id, 'ads_quality', CASE WHEN broken THEN 0 ELSE greatest(0, {_score('ads_quality')} - ({_WAIT})) END::INT, CASE WHEN broken THEN 'error' ELSE 'ok' END, CASE WHEN broken THEN {_FAILED} END FROM timed
UNION ALL SELECT page_id, 'links', {_score('links')}::INT, 'ok', NULL FROM timed"""
)

_SHARE = "(('0.' || lpad((n % {0})::VARCHAR, 2, '0'))::DOUBLE)::VARCHAR"
ORACLES["audience_lists"] = f"""WITH {_PRICED} SELECT o_orderkey, CASE WHEN n % 7 <> 0 THEN 'DE=' || {_SHARE.format(90)} || ',FR=' || {_SHARE.format(80)} || ',Unknown=0.01' ELSE '' END AS countries,
  CASE WHEN n % 7 <> 0 THEN 'a.test=' || {_SHARE.format(70)} || ',b.test=?' ELSE '' END AS referring_sites, CASE WHEN n % 7 <> 0 THEN 'c' || (n % 9) || '.test=1.0' ELSE '' END AS destination_sites, CASE WHEN n % 7 <> 0 THEN 'd.test=' || {_SHARE.format(60)} ELSE '' END AS similar_sites FROM priced"""
ORACLES["planner_ideas"] = """SELECT p_partkey, 0 AS place, p_name AS keyword, p_partkey * 10 AS avg_monthly_searches, 'LOW' AS competition, p_size::BIGINT AS competition_index, p_partkey AS low_cpc_micros, NULL::BIGINT AS high_cpc_micros FROM part
UNION ALL SELECT p_partkey, 1, 'second', NULL, NULL, NULL, NULL, 7 FROM part UNION ALL SELECT p_partkey, 2, '', NULL, NULL, NULL, NULL, NULL FROM part"""
ORACLES["backlink_reports"] = "SELECT p_partkey, 0 AS position, p_partkey AS total_backlinks, p_size::BIGINT AS referring_domains, NULL::BIGINT AS follow_count, 3::BIGINT AS nofollow_count FROM part"
ORACLES["competitor_reports"] = "SELECT p_partkey, i::INT AS position, CASE WHEN i % 2 = 1 THEN p_name ELSE 'c' || i || '.test' END AS domain, CASE WHEN i % 2 = 1 THEN 0.5::DOUBLE END AS affinity FROM part, range(10) t(i)"
ORACLES["organic_estimates"] = "SELECT p_partkey, p_partkey::DOUBLE AS organic_traffic, CASE WHEN p_partkey >= 1000000 THEN printf('%.1fM', p_partkey / 1000000.0) WHEN p_partkey >= 1000 THEN printf('%.1fK', p_partkey / 1000.0) ELSE p_partkey::VARCHAR END AS organic_display FROM part"
ORACLES["report_totals"] = _with(_ISSUES) + f"\nSELECT page_id, {_COUNTS}, count(*) AS n_findings FROM issues GROUP BY page_id"
ORACLES["report_categories"] = (
    _with(_WIDE, _LONG)
    + "\nSELECT page_id, category, score, (CASE category "
    + " ".join(f"WHEN '{c}' THEN {int(w * 100)}" for c, w in WEIGHTS.items())
    + f" END)::INT AS weight_pct, {_band('score')} AS band, list_position(["
    + ", ".join(f"'{c}'" for c in sorted(WEIGHTS, key=lambda c: -WEIGHTS[c]))
    + "], category)::INT AS place FROM long"
)
_METRICS = [
    ("title_length", "chars", "tl", "v BETWEEN 30 AND 60"), ("description_length", "chars", "dl", "v BETWEEN 70 AND 160"), ("has_canonical", "", "canonical::INT", "v = 1"), ("og_tags_count", "", "og_tags", "v >= 4"),
    ("has_lang", "", "(trim(coalesce(lang, '')) <> '')::INT", "v = 1"), ("h1_count", "", "h1s", "v = 1"), ("total_headings", "", "len(headings)", "v > 0"), ("hierarchy_valid", "", f"({_GAPS} = 0)::INT", "v = 1"), ("total_images", "", "n_imgs", None),
    ("missing_alt_count", "", "no_alt", "v = 0"), ("missing_dimensions_count", "", "no_size", "v = 0"), ("total_links", "", "n_links", None), ("internal_links", "", "int_links", "v > 0"), ("external_links", "", "ext_links", None), ("empty_invalid", "", "bad_links", "v = 0"),
    ("nofollow_internal", "", "nofollow_links", "v = 0"), ("semantic_elements", "", "(n_header > 0)::INT + (n_nav > 0)::INT + (n_main > 0)::INT + (n_article > 0)::INT + (n_section > 0)::INT + (n_aside > 0)::INT + (n_footer > 0)::INT", "v >= 4"),
    ("content_to_html_ratio", "%", "ratio", "v >= 25"), ("main_count", "", "n_main", "v = 1"),
]


def _metric(name: str, unit: str, value: str, good: str | None) -> str:
    verdict = "NULL::VARCHAR" if good is None else f"CASE WHEN {good} THEN 'good' ELSE 'bad' END"
    return f"SELECT page_id, '{name}' AS metric, '{unit}' AS unit, v::DOUBLE AS value, {verdict} AS verdict FROM (SELECT page_id, {value} AS v FROM facts)"


ORACLES["metric_verdicts"] = _with() + "\n" + " UNION ALL ".join(_metric(*m) for m in _METRICS)
ORACLES["form_facts"] = f"WITH {_MARKED} SELECT page_id, forms, labels, submits, robots FROM marked JOIN (VALUES (0, 1, 1, 2, 'noindex, follow'), (1, 2, 1, 0, 'max-snippet:0'), (2, 0, 1, 0, '')) k(form, forms, labels, submits, robots) ON form = page_id % 3"
_SKIPS = "list_transform(list_filter(list_zip(levels, levels[2:]), lambda p: p[2] - p[1] > 1), lambda p: 'H' || p[1] || ' > H' || p[2])"
_LEVEL_COUNTS = ", ".join(f"CASE WHEN h{i}s > 0 THEN 'H{i}: ' || h{i}s END" for i in range(1, 7))
ORACLES["heading_evidence"] = (
    _with()
    + f"\nSELECT page_id, 'headings_counted' AS rule_id, concat_ws(', ', {_LEVEL_COUNTS}) AS evidence FROM facts WHERE len(headings) > 0"
    + "".join(f"\nUNION ALL SELECT page_id, '{rule}', {_SKIPS}[{n}] FROM facts WHERE {_GAPS} >= {n}" for n, rule in ((1, "level_skipped"), (2, "level_skipped_again")))
)
ORACLES["searched_issues"] = _with(_ISSUES) + "\nSELECT page_id, category, rule_id, 'og:title, og:description, og:image, og:url' AS evidence FROM issues WHERE rule_id = 'og_incomplete'"
ORACLES["search_features"] = f"""WITH {_MARKED} SELECT page_id, features, types FROM marked JOIN (VALUES (0, 'Product Rich Snippet', 'Product'), (1, 'Recipe Rich Result;FAQ Rich Result', 'Recipe;Thing;FAQPage'), (2, '', ''), (3, 'Article / Top Stories', 'Gadget;Article'),
  (4, '', ''), (5, '', ''), (6, '', ''), (7, 'Breadcrumbs', 'BreadcrumbList')) k(e, features, types) USING (e)"""
ORACLES["typed_industries"] = f"WITH {_MARKED} SELECT page_id, industry, 0.7::DOUBLE AS industry_confidence, CASE WHEN coalesce(title, '') <> '' THEN 0.6::DOUBLE END AS description_confidence FROM marked JOIN (VALUES (0, 'Healthcare'), (1, 'Travel & Hospitality'), (2, 'Non-Profit'), (3, 'Finance')) k(t, industry) USING (t) JOIN ({_with()} SELECT page_id, title FROM facts) USING (page_id)"
ORACLES["json_documents"] = "SELECT to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority})::VARCHAR AS document FROM orders"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
