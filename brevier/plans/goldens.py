"""Cases of the fitness rules with the outcome that each must have, derived by hand."""

from __future__ import annotations

BRANDS = [
    ("Bowflex and Schwinn treadmill", "Bowflex"),
    ("Matrix film review", None),
    ("舒華SHUA體育", "SHUA"),
    ("the treadmill by Cybex", "Cybex"),
    ("Cybex stroller", None),
    ("sole F63", "Sole"),
    ("A manufacturer, True Fitness", "TRUE Fitness"),
    ("Weather today", None),
]
#: (title, brand, category)
CATEGORIES = [
    ("Peloton stock jumps", "Peloton", "finance"),
    ("Horizon treadmill review", "Horizon", "brand"),
    ("New training plan", None, "tech"),
    ("Global demand outlook", None, "market"),
    ("A new bike", "Peloton", "competitor"),
    ("A smart thing", "", "tech"),
]
PRODUCTS = [
    ("Treadmill and dumbbell set", "cardio"),
    ("Garmin smartwatch", "wearable"),
    ("Nutrition template", "other"),
    ("啞鈴", "strength"),
]
#: (title, brand, source, relaxed, reason)
EXCLUSIONS = [
    ("Oura smart ring update", None, "", False, "off_topic"),
    ("Baby stroller sale", None, "", False, "cross_industry_noise"),
    ("Weather today", None, None, False, "no_relevance"),
    ("Weather today", None, "x", True, None),
    ("x", None, " eBay Motors", False, "marketplace_spam"),
    ("treadmill replacement part", None, "", False, "marketplace_spam"),
    ("Tonal shift in decor", "Tonal", "", False, "cross_industry_noise"),
    ("Peloton breakaway by a rider", "Peloton", "", False, None),
    ("葉舒華 跑步機", "SHUA", "", False, "celebrity_noise"),
    ("舒華 news", "SHUA", "", False, "brand_ambiguous_no_context"),
    ("舒華體育 news", "SHUA", "", False, None),
    ("Peloton leggings", "Peloton", "", False, "apparel_noise"),
    ("Peloton bike leggings", "Peloton", "", False, None),
    ("gym news", "", "", False, None),
]
APPAREL = [
    ("Team jersey launch", True),
    ("New Jersey gym", False),
    ("Jersey City club", False),
    ("Running shoes and treadmill", False),
]
#: (title, date of its own, reason to leave an official item out)
OFFICIAL = [
    ("Peloton launches new bike", True, None),
    ("Peloton launches new bike", False, "official_no_real_date"),
    ("How to launch a workout", True, "official_not_news"),
    ("What is new", True, "official_not_news"),
]
#: (list path, path, leads to an article)
PATHS = [
    ("/stories/", "/stories/abc", True),
    ("/stories/", "/products/x", False),
    ("/stories/", "/stories/", False),
    ("/stories/", "/en/news/xyz/", True),
    ("/stories/", "/en/news/x", False),
]
#: (as written, as read on 2026-08-01)
DATES = [
    ("July 5, 2026", "2026-07-05"),
    ("5 Jul 2026", "2026-07-05"),
    ("7/5/2026", "2026-07-05"),
    ("2026-02-31", "2026-02-31"),
    ("2026-13-01", None),
    ("2036-01-01", None),
    ("2026-09-01", None),
    ("1999-12-31, July 5, 2026", None),
    ("2026-07-05T23:30:00-08:00", "2026-07-05"),
    ("junk", None),
]
#: (mail date, UTC date)
MAIL_DATES = [
    ("Mon, 06 Jul 2026 02:18:00 EST", "2026-07-06"),
    ("Sun, 05 Jul 2026 22:18:00 -0500", "2026-07-06"),
    ("05 Jul 2026 10:00 GMT", "2026-07-05"),
    ("5 Jul 2026 10:00:00", "2026-07-05"),
    ("bad", None),
]
#: (HTML, its text)
TEXTS = [
    ("<p>a &amp; b</p>&lt;b&gt;c<script>x</script>", "a & b c"),
    ("", ""),
    ("plain", "plain"),
]
