"""Sets of file extensions by kind."""

#: The extension sets, and the names by which they can be asked for.
AUDIO = "aac aif aiff amr ape au caf dts flac m4a mid midi mka mod mp1 mp2 mp3 mpc oga ogg opus ra ram snd spx tta voc wav wma wv".split()
VIDEO = "3g2 3gp asf avi divx dv f4v flv m2ts m2v m4v mkv mov mp4 mpeg mpg mts mxf ogm ogv rm rmvb ts vob webm wmv wtv y4m".split()
IMAGE = "apng avif bmp gif heic heif ico jfif jpeg jpg jpe jxl png psd svg tif tiff webp xcf".split()
DOCUMENT = "csv doc docx epub key md mobi numbers odp ods odt pages pdf ppt pptx rtf tex txt wpd wps xls xlsx xml".split()
ARCHIVE = "7z ace ar arc bz2 cab cpio deb dmg gz iso jar lz lz4 lzh lzo pkg rar rpm tar tbz tgz txz xar xz z zip zst".split()
EXECUTABLE = "app bin com cpl deb dll exe gadget img jar msi msp pif rpm scr so".split()
MACROS = {"audio": AUDIO, "video": VIDEO, "image": IMAGE, "picture": IMAGE, "doc": DOCUMENT, "document": DOCUMENT, "archive": ARCHIVE, "zip": ARCHIVE, "exe": EXECUTABLE}
TYPES = {
    "music": AUDIO, "audio": AUDIO, "video": VIDEO, "movie": VIDEO, "picture": IMAGE, "image": IMAGE, "document": DOCUMENT, "doc": DOCUMENT,
    "archive": ARCHIVE, "compressed": ARCHIVE, "executable": EXECUTABLE, "exe": EXECUTABLE, "program": EXECUTABLE, "application": EXECUTABLE,
}
