"""Thresholds and vocabularies of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on every one of them.


@dataclass(frozen=True)
class Settings:
    """Thresholds of one analysis; pass another instance to a query to change them."""

    z_threshold: float = 2.2
    min_delta: float = 0.10
    min_unit: int = 6
    persistence_share: float = 0.6
    water: float = 0.05
    vegetation: float = 0.30
    built: float = -0.08
    burn_before: float = 0.20
    detail_cap: int = 40
    max_epochs: int = 8
    usable_fraction: float = 0.25
    max_shift: float = 2.0
    season_days: int = 45
    max_cloud: float = 20.0
    relaxed_cloud: float = 45.0
    max_aoi: float = 0.5
    min_aoi: float = 0.012
    grid_size: int = 480
    least_valid: float = 0.55
    large_span: float = 0.40
    large_grid: int = 420
    report_shift: float = 0.02


SETTINGS = Settings()

MAD_TO_SIGMA = 1.4826
SIGMA_FLOOR = 1e-4
DN_SCALE = 1e-4
PEDESTAL = 1000
PEDESTAL_P01 = 700
PEDESTAL_PIXELS = 64
REFLECTANCE_MAX = 1.6
SCL_INVALID = (0, 1, 3, 8, 9, 10, 11)
SCL_DEGRADED = (2, 7)
ARCHIVE_START = 2016

#: mode: (label, index, direction)
MODES = {
    "urban_expansion": ("Urban / built-up expansion", "NDBI", "increase"),
    "vegetation_loss": ("Vegetation / forest loss", "NDVI", "decrease"),
    "vegetation_gain": ("Vegetation growth / regreening", "NDVI", "increase"),
    "water_loss": ("Water-body shrinkage", "MNDWI", "decrease"),
    "water_gain": ("Water expansion / flooding", "MNDWI", "increase"),
    "burn_scar": ("Burned area / fire scar", "NBR", "decrease"),
}

#: mode: name of one cluster
CLUSTER_NAMES = {
    "urban_expansion": "New built-up surface",
    "vegetation_loss": "Vegetation loss",
    "vegetation_gain": "Vegetation gain",
    "water_loss": "Water surface loss",
    "water_gain": "Water expansion",
    "burn_scar": "Burn scar",
}
OTHER_CLUSTER = "Surface change"

#: index: (name, formula, bands)
INDEX_META = {
    "NDVI": ("Normalised Difference Vegetation Index", "(NIR - Red) / (NIR + Red)", "B08, B04"),
    "NDBI": ("Normalised Difference Built-up Index", "(SWIR1 - NIR) / (SWIR1 + NIR)", "B11, B08"),
    "MNDWI": ("Modified Normalised Difference Water Index", "(Green - SWIR1) / (Green + SWIR1)", "B03, B11"),
    "NBR": ("Normalised Burn Ratio", "(NIR - SWIR1) / (NIR + SWIR1)", "B08, B11"),
}

SCL_LABELS = (
    "no data", "saturated", "dark area", "cloud shadow", "vegetation", "bare soil", "water", "unclassified",
    "cloud (medium prob)", "cloud (high prob)", "thin cirrus", "snow / ice",
)
#: Red, green and blue of each class of the scene classification, from 0.
SCL_COLOURS = (
    (12, 12, 14), (255, 0, 0), (47, 47, 47), (100, 50, 0), (46, 160, 67), (196, 168, 96), (30, 110, 220), (128, 128, 128),
    (200, 200, 200), (245, 245, 245), (170, 200, 235), (180, 230, 255),
)
#: (share of the range, (red, green, blue)) between which a heat colour is a linear mix.
HEAT_STOPS = (
    (0.00, (10, 16, 34)),
    (0.25, (24, 62, 120)),
    (0.45, (16, 132, 148)),
    (0.65, (232, 196, 62)),
    (0.85, (238, 118, 44)),
    (1.00, (240, 52, 72)),
)
OVERLAY_COLOURS = {"increase": (255, 68, 88), "decrease": (255, 176, 32)}
OVERLAY_OPACITY = 0.62
MASK_ALPHA = 210
NO_DATA_SHADE = 28
NO_DATA_HEAT = 22
STRETCH_LOW, STRETCH_HIGH, GAMMA = 0.02, 0.96, 1.05
HEAT_LOW, HEAT_HIGH = 0.02, 0.99
IMAGE_SIDE, THUMB_SIDE = 640, 132

#: Years of a question, as regular expressions over its lower-case text.
YEAR_SPAN = r"((?:19|20)\d{2})\s*(?:-|to|and|until|till|through|vs\.?|versus)\s*((?:19|20)\d{2})"
YEARS_BACK = r"(?:last|past|previous|recent)\s+(\d{1,2})\s*(?:year|yr)"
DECADE_BACK = r"(?:last|past)\s+decade"
YEAR_BACK = r"(?:last|past)\s+(?:year|12\s*months)"
YEAR_SINCE = r"since\s+((?:19|20)\d{2})"
ANY_YEAR = r"\b((?:19|20)\d{2})\b"
#: What is taken out of a question before its place is looked for, in this order.
PLACE_NOISE = (
    r"(?:between\s+)?(?:19|20)\d{2}\s*(?:-|to|and)\s*(?:19|20)\d{2}",
    r"\b(?:19|20)\d{2}\b",
    r"(?:last|past|previous|recent)\s+\d{1,2}\s*(?:year|yr)s?",
)
PLACE_WORDS = r"(?:in|near|around|at|for|within|inside|across|surrounding|close to)"
SMALL_PLACE_WORDS = r"(?:in|near|around|at|for|within)"
PLACE_TOKEN = r"(?:[A-Z][\w'\-]*|and|of|the|de|el|la|al)"
RISES = r"\b(increase|increased|growth|grew|gain|gained|more|greener)\b"
FALLS = r"\b(decrease|decreased|loss|lost|less|reduced|declin)\w*\b"

#: Study windows: degrees from which a region is country-sized, side of a window, cells of the scan, metres from which ground is land.
COUNTRY_SPAN, STUDY_SIDE, SCAN_X, SCAN_Y, LAND_METRES = 2.0, 0.5, 9, 7, 5.0
#: Where a window is probed, in half windows from its centre; by how much of a window it moves.
PROBES = (-0.9, -0.45, 0.0, 0.45, 0.9)
MOVE_STEPS = (0.25, 0.5, 0.75, 1.0)
#: Ways to move, in the order that decides between equals.
MOVES = ((0, 1), (0, -1), (-1, 0), (-1, 1), (-1, -1), (1, 0), (1, 1), (1, -1))
#: Kilometres a degree of an area's stated size.
KM_LON, KM_LAT = 111.32, 110.57

PHRASES = {
    "urban_expansion": (
        "urban expansion", "urban growth", "urban sprawl", "urbanisation", "urbanization", "built up", "built-up", "builtup", "new construction",
        "construction", "new buildings", "new building", "buildings appeared", "concrete", "development", "developed", "real estate", "housing",
        "settlement", "settlements", "infrastructure", "layout", "township", "encroachment", "encroach", "roads", "road development", "impervious",
        "city expanded", "city growth", "expansion of the city",
    ),
    "vegetation_loss": (
        "vegetation loss", "vegetation decline", "loss of vegetation", "deforestation", "deforested", "forest loss", "forest cover loss",
        "tree cover loss", "tree loss", "forests disappearing", "forest disappeared", "forests are disappearing", "losing forest",
        "green cover loss", "green cover reduction", "vegetation removed", "cleared", "clearing", "logging", "canopy loss", "barren",
        "vegetation reduced", "greenery reduced", "loss of greenery",
    ),
    "vegetation_gain": (
        "vegetation growth", "vegetation gain", "vegetation increased", "revegetation", "reforestation", "afforestation", "regreening",
        "greening", "green cover increase", "greener", "plantation", "crop growth", "more vegetation", "tree cover gain",
    ),
    "water_loss": (
        "water loss", "lake shrinking", "lakes became smaller", "lake shrank", "shrinking", "shrunk", "drying", "dried up", "drying up",
        "water reduced", "water body reduced", "reduced in area", "reservoir level", "receding", "receded", "water level dropped", "drought",
        "desiccation", "smaller lake", "lost water", "water decline",
    ),
    "water_gain": (
        "flood", "flooding", "flooded", "inundation", "inundated", "water expansion", "water expanded", "water increased", "submerged",
        "submergence", "overflow", "overflowed", "water spread", "deluge", "waterlogging", "water logging", "reservoir filled", "lake grew",
        "more water",
    ),
    "burn_scar": (
        "burn", "burned", "burnt", "burn scar", "fire", "wildfire", "forest fire", "bushfire", "fire damage", "scorched", "charred",
        "burned area", "fire affected",
    ),
}

CHANGE_CUES = (
    "change", "changed", "changing", "difference", "compare", "comparison", "before after", "over time", "trend", "evolution", "happened", "since",
    "between", "grew", "shrank", "expanded", "increase", "decrease", "loss", "gain", "appeared", "disappeared", "new",
)
SIMILARITY_CUES = ("similar", "like this", "same pattern", "comparable", "resembl", "other places", "elsewhere", "find more")
NEAR_WORDS = ("near", "around", "beside", "adjacent", "next to", "along", "close to", "by the")
NEAR_FEATURES = {
    "water": ("lake", "lakes", "pond", "ponds", "reservoir", "river", "rivers", "canal", "tank", "tanks", "water body", "water bodies", "coast", "shoreline", "wetland", "wetlands"),
    "forest": ("forest", "forests", "woodland", "reserve", "sanctuary", "national park", "jungle"),
    "urban": ("city", "town", "urban area", "settlement"),
    "farmland": ("farmland", "farm", "farms", "agriculture", "agricultural", "cropland", "fields", "crops"),
}
STOPWORDS = (
    "show", "me", "find", "where", "what", "which", "did", "does", "do", "has", "have", "had", "is", "are", "was", "were", "the", "a", "an", "in", "on",
    "at", "of", "for", "to", "from", "between", "and", "or", "near", "around", "close", "by", "over", "during", "since", "last", "past", "this", "that",
    "these", "those", "there", "here", "any", "all", "some", "new", "old", "please", "can", "you", "us", "our", "my", "his", "her", "its", "their",
    "area", "areas", "region", "regions", "place", "places", "zone", "zones", "district", "districts", "years", "year", "months", "month", "days",
    "day", "time", "period", "map", "image", "images", "satellite", "data", "analysis", "detect", "detection", "identify", "changes", "change",
    "happened", "occurred", "much", "many", "how", "why", "when",
    "urban", "expansion", "growth", "construction", "buildings", "building", "vegetation", "forest", "forests", "deforestation", "water", "lake",
    "lakes", "flood", "flooding", "loss", "gain", "cover", "green", "burn", "burned", "fire", "crop", "crops", "agriculture", "built", "up",
)
SUBJECTS = {
    "water": ("water bod", "water bodies", "waterbody", "lake", "lakes", "pond", "reservoir", "tank", "river", "wetland", "water level", "water"),
    "vegetation": ("vegetation", "forest", "tree", "canopy", "green cover", "greenery", "woodland", "jungle", "crop", "plantation"),
    "urban": ("building", "construction", "built", "city", "town", "settlement", "infrastructure", "road", "concrete"),
}
DOWN_VERBS = (
    "reduc", "shrink", "shrank", "shrunk", "declin", "decreas", "loss", "lost", "disappear", "dry", "dried", "smaller", "less", "fell", "drop", "receded",
    "vanish", "degrad", "depleted", "diminish",
)
UP_VERBS = ("increas", "expand", "grew", "grow", "gain", "more", "rise", "risen", "appear", "new", "spread", "larger", "bigger", "up")

#: (key, label, lon, lat, west, south, east, north); order decides between loose matches.
GAZETTEER = (
    ("hyderabad", "Hyderabad, Telangana, India", 78.4867, 17.3850, 78.30, 17.32, 78.62, 17.58),
    ("gachibowli", "Gachibowli, Hyderabad, India", 78.3489, 17.4401, 78.29, 17.39, 78.42, 17.49),
    ("kokapet", "Kokapet, Hyderabad, India", 78.3378, 17.4045, 78.29, 17.36, 78.39, 17.44),
    ("osman sagar", "Osman Sagar (Gandipet), Hyderabad, India", 78.3167, 17.3833, 78.25, 17.34, 78.38, 17.43),
    ("himayat sagar", "Himayat Sagar, Hyderabad, India", 78.3500, 17.3300, 78.28, 17.29, 78.41, 17.37),
    ("shamirpet", "Shamirpet Lake, Hyderabad, India", 78.5700, 17.6300, 78.52, 17.59, 78.62, 17.67),
    ("amaravati", "Amaravati, Andhra Pradesh, India", 80.5150, 16.5150, 80.44, 16.45, 80.60, 16.59),
    ("bengaluru", "Bengaluru, Karnataka, India", 77.5946, 12.9716, 77.45, 12.85, 77.75, 13.12),
    ("bangalore", "Bengaluru, Karnataka, India", 77.5946, 12.9716, 77.45, 12.85, 77.75, 13.12),
    ("chennai", "Chennai, Tamil Nadu, India", 80.2707, 13.0827, 80.13, 12.95, 80.33, 13.20),
    ("mumbai", "Mumbai, Maharashtra, India", 72.8777, 19.0760, 72.78, 18.95, 72.99, 19.28),
    ("delhi", "Delhi, India", 77.2090, 28.6139, 76.98, 28.45, 77.40, 28.78),
    ("pune", "Pune, Maharashtra, India", 73.8567, 18.5204, 73.72, 18.42, 74.00, 18.65),
    ("surat", "Surat, Gujarat, India", 72.8311, 21.1702, 72.72, 21.08, 72.95, 21.28),
    ("ahmedabad", "Ahmedabad, Gujarat, India", 72.5714, 23.0225, 72.46, 22.93, 72.70, 23.13),
    ("kolkata", "Kolkata, West Bengal, India", 88.3639, 22.5726, 88.26, 22.46, 88.46, 22.68),
    ("aralam", "Aralam Forest, Kerala, India", 75.8300, 11.9300, 75.76, 11.87, 75.92, 12.00),
    ("wayanad", "Wayanad, Kerala, India", 76.1320, 11.6854, 76.03, 11.59, 76.26, 11.79),
    ("araku", "Araku Valley, Andhra Pradesh, India", 82.8700, 18.3300, 82.78, 18.24, 82.97, 18.42),
    ("sundarbans", "Sundarbans, West Bengal, India", 88.8000, 21.9500, 88.66, 21.84, 88.95, 22.07),
    ("chilika", "Chilika Lake, Odisha, India", 85.3200, 19.7100, 85.16, 19.60, 85.50, 19.83),
    ("sambhar", "Sambhar Salt Lake, Rajasthan, India", 75.0800, 26.9300, 74.94, 26.85, 75.24, 27.01),
    ("ujjani", "Ujjani Reservoir, Maharashtra, India", 75.1200, 18.0800, 75.00, 18.00, 75.28, 18.18),
    ("nagarjuna sagar", "Nagarjuna Sagar Reservoir, Telangana, India", 79.3120, 16.5750, 79.18, 16.48, 79.44, 16.68),
    ("polavaram", "Polavaram, Andhra Pradesh, India", 81.6400, 17.2400, 81.54, 17.15, 81.75, 17.33),
)

#: Names of a signature's dimensions, and what an explanation calls those that it may name.
SIGNATURE_NAMES = (
    "veg_fraction_start", "veg_fraction_end", "veg_delta", "built_fraction_start", "built_fraction_end", "built_delta",
    "water_fraction_start", "water_fraction_end", "water_delta", "change_rate", "cluster_density", "fragmentation", "mean_patch_ha",
)
NAMED_DIMENSIONS = {
    "veg_delta": "change in vegetation cover",
    "built_delta": "change in built-up cover",
    "water_delta": "change in water extent",
    "change_rate": "proportion of area changed",
    "fragmentation": "how fragmented the change patches are",
    "mean_patch_ha": "typical patch size",
}
SIGNATURE_WEIGHTS = (0.7, 0.7, 1.4, 0.7, 0.7, 1.4, 0.7, 0.7, 1.4, 1.2, 0.9, 0.9, 0.8)
#: (key, label, lon, lat, mode, vector)
ARCHETYPES = (
    ("ref-periurban-sprawl", "Peri-urban sprawl archetype", 78.3489, 17.4401, "urban_expansion", (0.42, 0.31, -0.11, 0.18, 0.29, 0.11, 0.03, 0.03, 0.00, 0.09, 0.55, 0.30, 0.35)),
    ("ref-planned-township", "Planned township archetype", 80.5150, 16.5150, "urban_expansion", (0.55, 0.34, -0.21, 0.10, 0.27, 0.17, 0.02, 0.02, 0.00, 0.14, 0.15, 0.06, 0.85)),
    ("ref-reservoir-drawdown", "Reservoir drawdown archetype", 79.3120, 16.5750, "water_loss", (0.22, 0.26, 0.04, 0.09, 0.14, 0.05, 0.34, 0.19, -0.15, 0.13, 0.10, 0.04, 0.90)),
    ("ref-forest-clearing", "Forest clearing archetype", 76.1320, 11.6854, "vegetation_loss", (0.86, 0.74, -0.12, 0.04, 0.07, 0.03, 0.01, 0.01, 0.00, 0.08, 0.40, 0.22, 0.40)),
    ("ref-flood-inundation", "Flood inundation archetype", 88.8000, 21.9500, "water_gain", (0.51, 0.28, -0.23, 0.07, 0.06, -0.01, 0.09, 0.38, 0.29, 0.31, 0.20, 0.08, 0.80)),
)

#: Applied one after the other, whatever the case.
REWRITES = (
    (r"\billegal\b", "unpermitted-looking"),
    (r"\bencroachment\b", "possible boundary change"),
    (r"\bviolation\b", "condition requiring verification"),
    (r"\bcrime\b", "activity"),
    (r"\bculprit\b", "responsible party"),
    (r"\bproves\b", "indicates"),
    (r"\bproof\b", "evidence"),
    (r"\bcertainly\b", "likely"),
    (r"\bdefinitely\b", "likely"),
    (r"\bguarantee[sd]?\b", "indicates"),
)
