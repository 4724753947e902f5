"""Default rule tables of the jobs."""

# Roster kinds in feed order with their labels.
TARGETS = (("senators", "参議院一般議員"), ("representatives", "衆議院議員"), ("ministers", "大臣"), ("viceMinisters", "副大臣"), ("parliamentarySecretaries", "大臣政務官"), ("councilorsOfficersList", "参議院役員"), ("houseOfficersList", "衆議院役員一覧"))
# Compared fields and their words in change sentences.
CHANGE_LABELS = (("name", "氏名変更"), ("kana", "ふりがな変更"), ("role", "役職変更"), ("party", "所属変更"), ("district", "選挙区変更"), ("terms", "当選回数変更"))
# Words of a changed asset and of an absent value.
ASSET_CHANGED, NOTHING = "顔写真を更新", "なし"
# Reasons of removals and additions: key, label, pattern.
REMOVED_REASONS = (("辞任", "辞任報道あり", "辞任|辞職|議員辞職|辞任届"), ("更迭", "更迭報道あり", "更迭|罷免"), ("失職", "失職報道あり", "失職"), ("死去", "死去報道あり", "死去|逝去|死去へ"), ("落選", "落選報道あり", "落選"))
ADDED_REASONS = (("繰上げ当選", "繰上げ当選報道あり", "繰上げ当選|繰り上げ当選"), ("補欠選挙", "補欠選挙報道あり", "補欠選挙|補選"), ("当選", "当選報道あり", "初当選|当選|初登院"), ("就任", "就任報道あり", "就任|任命|起用"))
# News outlets.
OUTLETS = "NHK|共同通信|時事通信|朝日新聞|読売新聞|毎日新聞|産経新聞|日経|東京新聞"
# Items of a feed, those of them with reasons, entries of a news feed.
FEED_ITEMS, FEED_REASONS, FEED_ENTRIES = 80, 12, 8
# Sources whose assets are no guesses, and the order sources are asked in.
TRUSTED_SOURCES = ("wikipedia", "wikidata-commons", "official-profile", "official-manual", "party-site", "trusted-fallback", "manual-source-page", "manual-direct-image", "yomiuri-winners")
SOURCE_ORDER = ("yomiuri", "official", "party", "wikipedia", "wikimedia", "news", "web")
# Words that mark a page as one about a person of the roster.
PAGE_TOKENS = ("衆議院", "議員", "プロフィール", "会派", "公式サイト", "自由民主党", "立憲民主党", "公明党", "維新", "国民民主党", "参政党", "開票結果", "当選者", "読売新聞")
# Assets and sources whose lower part is masked.
MASK_PATTERN = r"party-site|trusted-fallback|web-fallback|manual-direct-image|go2senkyo|smartvote|senkyo\.janjan|jimin\.jp|cdp-japan\.jp|o-ishin\.jp|komei\.or\.jp|new-kokumin\.jp|jcp\.or\.jp|reiwa-shinsengumi\.com|sanseito\.jp|sdp\.or\.jp|hoshuto\.jp|選挙|ポスター|公認|manifesto|policy"
# Label of people without a group.
NO_GROUP = "無所属"
# Events kept of a study history, entries kept of a feed history.
HISTORY_EVENTS, FEED_HISTORY = 2000, 20
# Reasons for a review in their order, with the fields whose text must fit and the pattern.
REVIEW_REASONS = (
    ("building_image", ("image", "image_source_url"), "diet|kokkai|building|議事堂|parliament|国会議事堂"),
    ("poster_image", ("image", "image_source_url"), "poster|flyer|leaflet|manifesto|選挙公報|senkyo"),
    ("sns_or_video_thumbnail", ("image", "image_source_url"), r"youtube|facebook|x\.com|twitter|instagram"),
    ("estimated_candidate", (), "ai_guess"),
    ("manual_source_page", ("image_source",), "manual-source-page|manual-direct-image"),
    ("trusted_fallback_review", ("image_source",), "trusted-fallback"),
    ("needs_manual_check", ("image_source",), "web-fallback"),
)
# The reason of encyclopaedia assets that show a crowd.
FAR_REASON, FAR_PATTERN = "face_too_far", "geta_zoutei|集合|group|speech|街頭|演説"
# Assets that a search never takes.
SEARCH_BAD = r"logo|icon|banner|spacer|pixel|sprite|button|btn|share|thumbnail-default|default-user|placeholder|noimage|no-image|ogp-default|header|footer|youtube|facebook|x\.com|twitter|instagram|line|amazons3.*logo|favicon|thumb|group|集合|街頭|演説|speech|rally|building|議事堂|parliament|kensei|assembly"
# Weights of assets by the field that fits a pattern: of a search, of a roster's pages, of photo pages.
SEARCH_WEIGHTS = (
    ("url", r"upload\.wikimedia|commons\.wikimedia", 10),
    ("url", "portrait|profile|face|kao|photo|member|giin|politician|headshot", 4),
    ("page", "member|profile|giin|politician|representative", 2),
    ("hint", "meta", 1),
    ("hint", "figure", 1),
    ("hint", "official|manual", 2),
    ("url", r"\b(400|500|600|700|800|900|1000)\b", 1),
    ("alt", "speaker|speech|meeting|街頭|街宣|演説|youtube|サムネ|集合|group", -8),
    ("url", "poster|flyer|bill|leaflet|senkyo|選挙|policy|manifesto", -3),
    ("url", "building|議事堂|parliament", -8),
    ("url", r"go2senkyo|smartvote|senkyo\.janjan", 3),
    ("url", r"jimin\.jp|cdp-japan\.jp|o-ishin\.jp|komei\.or\.jp|new-kokumin\.jp|jcp\.or\.jp|reiwa-shinsengumi\.com|sanseito\.jp", 4),
)
ROSTER_WEIGHTS = (
    ("url", "itdb_giinprof", 10),
    ("url", "portrait|profile|face|kao|photo|member|giin|politician|article|upload|commons", 2),
    ("url", "logo|icon|banner|spacer|line|pixel|print|btn|button|share", -4),
)
PHOTO_WEIGHTS = (
    ("all", "photo|portrait|profile|member|candidate|win|face|kao", 8),
    ("all", "logo|icon|banner|btn|button|sprite|loading", -20),
    ("all", "no-photo|default", -30),
)
# Profile pages (their ids' pattern) and what stands before and after the id in the asset's URL.
UPPER_PROFILE = (r"/profile/(\d+)\.htm$", "https://www.sangiin.go.jp/japanese/joho1/kousei/giin/photo/g", ".jpg")
