"""Fixed values.

Words, numbers and patterns that results depend on. They are plain data; every operator
takes them as a default argument, so a caller with other labels or bounds passes their own.
"""

# Label of each legacy nation name. Names not listed pass through.
NATION_LABELS = {
    "USA": "미국",
    "Germany": "독일",
    "USSR": "소련",
    "Britain": "영국",
    "Japan": "일본",
    "China": "중국",
    "Italy": "이탈리아",
    "France": "프랑스",
    "Sweden": "스웨덴",
    "Israel": "이스라엘",
}

# Label of each legacy category name. Names not listed pass through.
CATEGORY_LABELS = {
    "Light Tank": "경전차",
    "Medium Tank": "중형전차",
    "Heavy Tank": "중전차",
    "Tank Destroyer": "구축전차",
    "SPAA": "자주대공포",
}

# Allowed game modes of a roster.
GAME_MODES = ("Arcade", "Realistic", "Simulator")

# Numbers of slots, tiers and the lowest rating.
FIRST_SLOT, LAST_SLOT = 1, 10
LOWEST_TIER, HIGHEST_TIER = 1, 8
LOWEST_RATING = 1.0

# Fixed value: peers are the units rated within this distance of a roster's cap, ends included.
BAND_HALF_WIDTH = 1.0

# Edges (percent) and words of the verdict on a difference.
VERDICT_EDGES = (5, 15, 35)
VERDICTS = {
    "very_high": "매우 높음",
    "high": "높음",
    "slightly_high": "약간 높음",
    "similar": "비슷함",
    "slightly_low": "약간 낮음",
    "low": "낮음",
    "very_low": "매우 낮음",
}

# Metric column, label, family and measure of the four compared metrics.
METRICS = (
    ("pen", "관통력", "penetration", "mm"),
    ("front", "정면 장갑", "armor", "mm"),
    ("side", "측면 장갑", "armor", "mm"),
    ("rear", "후면 장갑", "armor", "mm"),
)

# What stands in for a value that is not there.
NO_VALUE = "-"
DEFAULT_MEDIA_PATH = "assets/vehicle_placeholder.svg"

# Path prefixes that mark a remote or inline picture, and the asset folder.
REMOTE_PREFIXES = ("http://", "https://", "data:image")
ASSET_FOLDER = "assets/"
