"""Fixed values of the engine: sizes, limits and lists that results depend on."""

CHUNK_SIZE = 1024
CHUNK_OVERLAP = 64
CHUNK_CHARS = 3000
TOP_K = 50
MAX_INPUT_TOKENS = 400_000
EMBED_CHARS = 3000
EMBED_BATCH = 20
EMBED_ATTEMPTS = 3
#: Seconds that a file may take to parse, and one whose text is read from pictures.
PARSE_SECONDS = 60
OCR_SECONDS = 300
EXTENSIONS = ("docx", "xlsx", "vsdx", "pdf", "zip", "rar", "png", "jpg", "jpeg", "bmp", "tiff", "tif", "dxf", "csv", "doc", "xls", "ppt", "pptx")
PLAIN_EXTENSIONS = ("txt", "csv", "md", "py", "json", "xml", "html", "htm", "log")
FILE_TYPES = {
    "docx": "word", "doc": "word", "xlsx": "excel", "xls": "excel", "csv": "excel", "pdf": "pdf", "vsdx": "visio", "zip": "archive", "rar": "archive",
    "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "tiff": "image", "tif": "image", "pptx": "ppt", "ppt": "ppt", "dxf": "cad", "txt": "text", "md": "text",
}
MAX_SESSIONS = 200
MAX_TURNS = 500
HISTORY_TURNS = 50
# Lines that start a section of a flat outline and of a numbered one, the title of an outline without any.
OUTLINE_HEADER = r"^[（(]?[一二三四五六七八九十\d]+[）).、]|^[第].*[节章条]|^[A-Z][.!]"
OUTLINE_NUMBERED = r"^(\d+(?:\.\d+)*)[.、\s]\s*(.*)"
OUTLINE_WHOLE = "分析任务"
