"""Fixed values. Results depend on these literally, so they are stated once, as text, in this file."""

# Pages and search keywords that count as promotional.
PROMO_PATTERN = r"(?i)\b(promo|offer|discount|deal|sale|coupon)\b"

# What is removed from a URL, in this order, and what is left in its place.
URL_PARTS = {
    "parameters": [(r"\?.*$|#.*", "")],
    "protocol": [(r"^(https?://|ftp://)", "")],
    "domain": [(r"^(https?://|ftp://)?[^/]+/", "/")],
    "all": [(r"\?.*$|#.*", ""), (r"^(https?://|ftp://)", ""), (r"^[^/]+/", "/")],
}

# Traffic categories of a source name.
SEARCH_SOURCES = ["google", "bing", "yahoo"]
SOCIAL_SOURCES = ["facebook", "instagram", "twitter"]

# Channel rules: patterns are searched anywhere in the lower-cased text.
SITES = {
    "Shopping": r"(alibaba|amazon|google shopping|shopify|etsy|ebay|stripe|walmart)",
    "Search": r"(baidu|bing|duckduckgo|ecosia|google|yahoo|yandex)",
    "Social": r"(badoo|facebook|fb|instagram|linkedin|pinterest|tiktok|twitter|whatsapp)",
    "Video": r"(dailymotion|disneyplus|netflix|youtube|vimeo|twitch)",
}
# Order in which site families are tried, paid and organic.
PAID_ORDER = ["Shopping", "Search", "Social", "Video"]
ORGANIC_ORDER = ["Shopping", "Social", "Video", "Search"]
PAID_MEDIUMS = r"(cp.*|ppc|paid.*)"
EMAIL_NAMES = r"(email|e-mail|e_mail|e mail)"
# Channel of a medium that names it outright.
MEDIUM_CHANNELS = {"affiliate": "Affiliates", "referral": "Referral", "audio": "Audio", "sms": "SMS"}
PUSH_MEDIUMS = r"(mobile|notification)"
DISPLAY_MEDIUMS = ["display", "banner", "expandable", "interstitial", "cpm"]
SOCIAL_MEDIUMS = ["social", "social-network", "social-media", "sm", "social network", "social media"]

# Source label given to traffic that carries a paid click id.
PAID_CLICK_SOURCE = "google / cpc"

# Events counted by the per-user pivot, in output order.
PIVOT_EVENTS = [
    "session_start", "page_view", "signup_success", "login_success", "whitelabel_final_step",
    "upgrade", "cancellation", "purchase", "contact_telegram",
]

# Events that count as an interaction before a purchase.
TOUCH_EVENTS = ["session_start", "page_view", "click"]

# Estimated page views per user, by consent state.
CONSENT_FACTORS = {"Granted": 2.0, "Denied": 3.0}

# Search-appearance flags of the URL-grain search table, in output order.
APPEARANCE_FLAGS = [
    "is_amp_top_stories", "is_amp_blue_link", "is_job_listing", "is_job_details", "is_tpf_qa", "is_tpf_faq",
    "is_tpf_howto", "is_weblite", "is_action", "is_events_listing", "is_events_details",
    "is_search_appearance_android_app", "is_amp_story", "is_amp_image_result", "is_video", "is_organic_shopping",
    "is_review_snippet", "is_special_announcement", "is_recipe_feature", "is_recipe_rich_snippet",
    "is_subscribed_content", "is_page_experience", "is_practice_problems", "is_math_solvers",
    "is_translated_result", "is_edu_q_and_a", "is_product_snippets", "is_merchant_listings", "is_learning_videos",
]

# Label of a search row by the first flag that is set.
AMP_CLASSES = [
    ("is_amp_top_stories", "AMP Top Stories"),
    ("is_amp_blue_link", "AMP Blue Link"),
    ("is_amp_story", "AMP Story"),
    ("is_amp_image_result", "AMP Image Result"),
]

# Item fields of the event export, in output order.
ITEM_TEXT_FIELDS = [
    "item_id", "item_name", "item_brand", "item_variant", "item_category", "item_category2", "item_category3",
    "item_category4", "item_category5",
]
ITEM_NUMBER_FIELDS = [
    ("price_in_usd", "double"), ("price", "double"), ("quantity", "bigint"), ("item_revenue_in_usd", "double"),
    ("item_revenue", "double"), ("item_refund_in_usd", "double"), ("item_refund", "double"),
]
ITEM_LIST_FIELDS = [
    "coupon", "affiliation", "location_id", "item_list_id", "item_list_name", "item_list_index", "promotion_id",
    "promotion_name", "creative_name", "creative_slot",
]
