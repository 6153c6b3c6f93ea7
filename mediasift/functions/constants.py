"""Fixed values of the metadata rules: names, patterns and lookup tables."""

# (name, patterns, category, suspicious for raw footage); first match in this order wins
ENCODER_SIGNATURES = (
    ("Apple iPhone / iPad", ("apple", r"com\.apple", "iphone", "ipad"), "mobile_camera", False),
    ("Samsung Camera", ("samsung", r"sec\b"), "mobile_camera", False),
    ("Android Generic", ("android", "google", r"com\.android"), "mobile_camera", False),
    ("Huawei Camera", ("huawei", "kirin"), "mobile_camera", False),
    ("Canon Camera", ("canon", "eos"), "professional_cam", False),
    ("Sony Camera", ("sony", "xavcs"), "professional_cam", False),
    ("GoPro", ("gopro", "hero"), "professional_cam", False),
    ("DJI Drone", ("dji", "djivideo"), "professional_cam", False),
    ("Adobe Premiere", ("adobe premiere", "premiere pro", "mc_adobe"), "video_editor", True),
    ("Adobe After Effects", ("after effects", "adobe ae"), "video_editor", True),
    ("DaVinci Resolve", ("davinci", "blackmagic", "resolve"), "video_editor", True),
    ("Final Cut Pro", ("final cut", "fcp", "apple final"), "video_editor", True),
    ("iMovie", ("imovie",), "video_editor", False),
    ("HandBrake", ("handbrake",), "transcoder", True),
    ("FFmpeg / Lavf / Lavc", ("lavf", "lavc", "ffmpeg", "libav"), "transcoder", True),
    ("OBS Studio", ("obs", "obs-output"), "screen_recorder", True),
    ("Camtasia", ("camtasia", "techsmith"), "screen_recorder", True),
    ("YouTube Processing", ("youtube", "ytdl"), "platform_reencode", False),
    ("WhatsApp", ("whatsapp",), "platform_reencode", False),
)

CONTAINER_CODECS = {
    "wav": ("pcm_s16le", "pcm_s24le", "pcm_f32le", "pcm_s32le", "pcm_alaw", "pcm_mulaw", "adpcm_ms", "pcm_s8"),
    "mp3": ("mp3", "mp3float"),
    "aac": ("aac",),
    "mov,mp4,m4a,3gp,3g2,mj2": ("aac", "mp3", "pcm_s16le", "opus", "alac", "ac3"),
    "ogg": ("vorbis", "opus", "flac"),
    "flac": ("flac",),
    "amr": ("amr_nb", "amr_wb"),
    "matroska,webm": ("vorbis", "opus", "aac", "mp3", "flac"),
}

CODEC_CEILING_HZ = {
    "amr_nb": 3500.0, "pcm_alaw": 3500.0, "pcm_mulaw": 3500.0, "amr_wb": 7000.0, "mp3": 7200.0, "aac": 7500.0, "vorbis": 7500.0, "opus": 7500.0, "flac": 8000.0,
}

SOFTWARE_CODECS = (
    ("apple", ("h264", "hevc", "aac")),
    ("final cut", ("h264", "hevc", "prores")),
    ("adobe premiere", ("h264", "hevc", "dnxhd")),
    ("handbrake", ("h264", "hevc", "vp9")),
    ("ffmpeg", ("h264", "hevc", "vp8", "vp9", "av1")),
    ("x264", ("h264",)),
    ("x265", ("hevc",)),
    ("libvpx", ("vp8", "vp9")),
)

LOSSY_CODECS = ("mp3", "aac", "vorbis", "opus", "amr_nb", "amr_wb", "pcm_alaw", "pcm_mulaw")
MOBILE_LOSSLESS_CODECS = ("alac",)
CODEC_ALIASES = {"pcm_s32le": "pcm_s16le", "pcm_s8": "pcm_s16le", "mp3float": "mp3"}
CODEC_MAX_HZ = {"amr_nb": 4000.0, "pcm_alaw": 4000.0, "pcm_mulaw": 4000.0, "amr_wb": 8000.0}

EDITOR_WORDS = (
    "audacity", "adobe audition", "adobe premiere", "garageband", "logic pro", "reaper", "ocenaudio", "wavosaur", "soundforge", "cubase", "ableton", "fl studio", "goldwave", "wavepad",
)
GENERIC_ENCODER_PATTERN = r"^(lavf\d|lavc\d|libav|ffmpeg)"
DEVICE_WORDS = ("apple", "samsung", "google", "huawei", "xiaomi", "oneplus", "android", "ios", "iphone", "quicktime", "whatsapp", "zoom", "teams", "meet", "skype", "lame")

SCREENSHOT_WORDS = (
    "snipping tool", "snip & sketch", "screenshot", "flameshot", "greenshot", "sharex", "lightshot", "spectacle", "gnome-screenshot", "gnome screenshot", "xfce4-screenshooter",
    "scrot", "maim", "screencapture", "grab", "windows.screenshot", "xbox game bar", "snipaste", "ksnip", "shutter",
)
SCREEN_SIZES = (
    (1920, 1080), (1366, 768), (1536, 864), (1440, 900), (1280, 720), (1280, 800), (1280, 1024), (1024, 768), (1600, 900), (2560, 1440), (3840, 2160), (2560, 1600), (3440, 1440),
    (2880, 1800), (2880, 1620), (3072, 1728), (5120, 2880), (1080, 1920), (1440, 2560), (1080, 2400), (1170, 2532), (1284, 2778), (1125, 2436), (1242, 2688), (750, 1334), (828, 1792), (1080, 2340),
)
SCREEN_DPIS = (72, 96, 120, 144, 192)
CAMERA_TAGS = (271, 272, 37386, 33434, 33437, 34855)
SCREENSHOT_WEIGHTS = {"software_tag": 45, "missing_camera_exif": 20, "screen_dpi": 10, "screen_dimensions": 10, "no_exif_thumbnail": 8, "png_no_camera": 15, "sharp_edges": 12}
CROP_WEIGHTS = {"exif_dimension_mismatch": 40, "grid_offset": 60}
VIDEO_METADATA_WEIGHTS = {"timestamp": 0.30, "encoder": 0.25, "container": 0.25, "completeness": 0.10, "gps": 0.10}
IMAGE_POINTS = {"ela": (15.0, 30.0, 8.0, 18.0), "noise": (50.0, 30.0, 25.0, 18.0), "clone": (5.0, 35.0, 2.0, 20.0)}
IMAGE_RESAVED_POINTS, IMAGE_SPARSE_EXIF_POINTS = 25.0, 17.0
CONFIDENCE_CUTS = {
    "metadata": (0.30, 0.55, 0.75), "compression": (0.30, 0.55, 0.75), "noise": (0.25, 0.50, 0.70), "temporal": (0.30, 0.55, 0.75), "lighting": (0.35, 0.60, 0.78), "audio": (0.30, 0.55, 0.75),
}
CONFIDENCE_LEVELS = ("authentic", "likely_authentic", "inconclusive", "likely_tampered")
