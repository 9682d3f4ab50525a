"""Names, extensions and texts that results depend on."""

# Operating-system bookkeeping files, never inventory.
METADATA_FILES = [
    ".DS_Store", ".AppleDouble", ".LSOverride", ".Spotlight-V100", ".Trashes", ".fseventsd",
    ".VolumeIcon.icns", ".com.apple.timemachine.donotpresent", "Icon",
]
METADATA_PREFIX = "._"

# System directories whose contents are never read.
METADATA_DIRS = [".Spotlight-V100", ".Trashes", ".fseventsd", ".DocumentRevisions-V100", ".TemporaryItems"]

# Version control, build output and caches (exact), and opaque bundles (any case).
DEV_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "bower_components", ".venv", "venv", "__pycache__", ".tox",
    ".mypy_cache", ".pytest_cache", ".cargo", "target", ".gradle", ".m2", ".next", ".nuxt",
    ".parcel-cache", "DerivedData", ".cache", "Caches",
]
BUNDLE_SUFFIXES = [".app", ".framework", ".bundle", ".xcodeproj"]

# Media extensions, lower case.
PHOTO_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif", "avif", "dng", "cr2",
    "cr3", "nef", "arw", "orf", "rw2", "raf", "pef", "srw",
]
VIDEO_EXTENSIONS = [
    "mp4", "mov", "m4v", "avi", "mkv", "webm", "mpg", "mpeg", "mts", "m2ts", "3gp", "3g2", "wmv", "flv",
    "ts", "vob", "hevc", "asf", "mod", "tod",
]

# Keeper rules and the reasons a plan states.
KEEPER_REASONS = {
    "shortest_path": "keeper: shortest path",
    "longest_path": "keeper: longest path",
    "oldest": "keeper: oldest modified time",
    "newest": "keeper: newest modified time",
}
HARDLINK_REASON = "hardlink of keeper — no space freed"
DUPLICATE_REASON = "duplicate of keeper"

# The reasons that a manifest states.
REASON_CANCELED = "canceled before move"
REASON_GONE = "source file no longer exists"
REASON_DIFFERS = "content differs from keeper "
REASON_VERIFY = "verify error: "
REASON_MOVE = "move error: "

LEGACY_PREFIX = "p:"
LOG_LEVELS = ["info", "warn", "error", "dry", "real"]
LOG_RING = 2000
SAMPLE_CAP = 500
DETAILED_ERRORS = 20
PROGRESS_FILES = 256
PROGRESS_DIRS = 64
READ_BUFFER = 8 << 20
COMPARE_BLOCK = 64 << 10
HASH_PROBE = 8
RECENT_SCANS = 50
TOP_EXTENSIONS = 7

FRAMES = 8
ORIENTATIONS = 4
MIN_MATCHES = 4
MAX_DISTANCE = 10

QUARANTINE_LOG = "Quarantine-Log.csv"
QUARANTINE_COLUMNS = ["timestamp", "status", "original_path", "quarantine_path", "size_bytes", "hash", "reason"]
REPORT_COLUMNS = ["hash", "media_kind", "group_size_bytes", "copies", "wasted_bytes", "path", "normalized_path", "source_root"]
