r"""Patterns of reports and feed entries, in the syntax that Python's and Java's expressions share.

All are fixed values: which sections, pages and entries are found depends on exactly these.
"""

# ---- fixed values: annual reports ----
#: What follows the number of an item heading.
HEADING_END = r"[ \t]*[.*~\-:\s(–—]"
#: A heading whose letters stand apart: indent, number, letter.
SPACED_ITEM = r"(?im)^([ \t]*)I[ \t]*T[ \t]*E[ \t]*M[ \t]+(\d{1,2})[ \t]*([A-C]?)\b"
#: A line of nothing but a page number.
PAGE_NUMBER = r"(?m)^[ \t]*-{0,5}[ \t]*\d{1,4}[ \t]*-{0,5}[ \t]*$"
#: More newlines than a blank line has.
BLANK_LINES = r"\n{3,}"
TAG = r"<[^>]*>"
#: Inline-XBRL headers and blocks that aren't displayed.
HIDDEN = [r"(?is)<ix:header\b[^>]*>.*?</ix:header>", r'(?is)<div[^>]*style="[^"]*display:\s*none[^"]*"[^>]*>.*?</div>']

# ---- fixed values: feed entries, the first group is the field ----
FEED_CIK = r"/edgar/data/(\d+)/"
FEED_COMPANY = r"^.*? - (.+?)\s*\(\d+\)"
FEED_FILED = r"Filed:\s*(\d{4}-\d{2}-\d{2})"
FEED_ITEM = r"Item (\d+(?:\.\d+)?):"
