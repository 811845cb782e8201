"""Names and labels that results depend on."""

# Directories left out of a scan by name.
NOISE_DIRS = (
    ".git",
    "node_modules",
    "vendor",
    ".DS_Store",
    "__pycache__",
    ".idea",
    ".vscode",
)

# Extension -> label.
TYPE_LABELS = {
    ".go": "Go source",
    ".py": "Python source",
    ".js": "JavaScript source",
    ".ts": "TypeScript source",
    ".jsx": "React source",
    ".tsx": "React source",
    ".java": "Java source",
    ".c": "C source",
    ".h": "C header",
    ".cpp": "C++ source",
    ".rs": "Rust source",
    ".rb": "Ruby source",
    ".php": "PHP source",
    ".sh": "Shell script",
    ".html": "HTML document",
    ".css": "Stylesheet",
    ".json": "JSON data",
    ".yaml": "YAML data",
    ".yml": "YAML data",
    ".xml": "XML data",
    ".toml": "TOML data",
    ".md": "Markdown document",
    ".txt": "Text document",
    ".pdf": "PDF document",
    ".doc": "Word document",
    ".docx": "Word document",
    ".xls": "Excel spreadsheet",
    ".xlsx": "Excel spreadsheet",
    ".ppt": "PowerPoint presentation",
    ".pptx": "PowerPoint presentation",
    ".csv": "CSV data",
    ".jpg": "JPEG image",
    ".jpeg": "JPEG image",
    ".png": "PNG image",
    ".gif": "GIF image",
    ".svg": "SVG image",
    ".bmp": "Bitmap image",
    ".webp": "WebP image",
    ".ico": "Icon",
    ".mp3": "MP3 audio",
    ".wav": "WAV audio",
    ".flac": "FLAC audio",
    ".mp4": "MP4 video",
    ".mov": "QuickTime video",
    ".mkv": "Matroska video",
    ".avi": "AVI video",
    ".zip": "ZIP archive",
    ".tar": "TAR archive",
    ".gz": "Gzip archive",
    ".rar": "RAR archive",
    ".7z": "7-Zip archive",
    ".exe": "Windows executable",
    ".dll": "Windows library",
    ".so": "Shared library",
    ".dmg": "macOS disk image",
    ".sql": "SQL script",
    ".db": "Database file",
    ".log": "Log file",
    ".env": "Environment config",
    ".lock": "Lock file",
    ".mod": "Go module file",
    ".sum": "Go checksum file",
}

# How files without a known or any extension are shown.
NO_EXTENSION = "(no extension)"
NO_EXTENSION_LABEL = "File (no extension)"

# Mime types of a cloud drive.
FOLDER_MIME = "application/vnd.google-apps.folder"
NATIVE_MIME_LABELS = {
    "application/vnd.google-apps.document": "Google Doc",
    "application/vnd.google-apps.spreadsheet": "Google Sheet",
    "application/vnd.google-apps.presentation": "Google Slide",
    "application/vnd.google-apps.form": "Google Form",
    "application/vnd.google-apps.drawing": "Google Drawing",
    "application/vnd.google-apps.script": "Google Apps Script",
    "application/vnd.google-apps.shortcut": "Google Drive shortcut",
}

# Id and display name of a drive's root, and the words that mean it.
DRIVE_ROOT_ID = "root"
DRIVE_ROOT_NAME = "My Drive"
DRIVE_ROOT_WORDS = ("", "root", "my drive")

# Size units accepted when a size is parsed.
SIZE_UNITS = {
    "": 1,
    "B": 1,
    "KB": 1000,
    "MB": 1000**2,
    "GB": 1000**3,
    "TB": 1000**4,
    "K": 1024,
    "M": 1024**2,
    "G": 1024**3,
    "T": 1024**4,
    "KIB": 1024,
    "MIB": 1024**2,
    "GIB": 1024**3,
    "TIB": 1024**4,
}

# Limits of content search.
GREP_MAX_FILE_BYTES = 50 * 1024 * 1024
GREP_MAX_LINE_BYTES = 1024 * 1024
