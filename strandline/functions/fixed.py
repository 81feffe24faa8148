"""Names, markers and verdicts that results depend on."""

# Names that say nothing about their origin.
COMMON_FIELDS = (
    "value", "name", "type", "data", "options", "parent", "description", "instance", "port", "out", "properties", "project", "next", "id", "listeners", "status", "target", "result", "index", "buffer",
    "values", "count", "size", "key", "path", "cache", "map", "file", "context", "initialized", "verbose", "version", "debug", "message", "attributes", "url", "DEBUG", "NAME", "state", "source",
    "password", "text", "start", "factory", "entries", "buf", "args", "logger", "config", "length", "encoding", "method", "resources", "timeout", "filename", "offset", "server", "mode", "in", "connection",
)
COMMON_VARIABLES = ("options", "debug", "verbose", "optarg", "optopt", "optfind", "optind", "opterr")
COMMON_METHODS = ("main",)

# Calls of functions that ought not to be used (CERT rules ENV33-C and MSC24-C).
ENV33_C = ("system",)
MSC24_C = ("gets", "asctime", "atof", "atoi", "atol", "atoll", "ctime", "fopen", "freopen", "rewind", "setbuf")

# Texts that point to a licence, and to a place where projects are hosted.
LICENCE_MARKERS = {
    "GNU": ("General Public License", "http://www.gnu.org/licenses/", "http://gnu.org/licenses/", "http://www.gnu.org/gethelp/", "http://www.gnu.org/software/"),
    "GPL": ("http://gnu.org/licenses/gpl.html", "http://www.gnu.org/licenses/gpl.html", "http://www.gnu.org/licenses/gpl.txt", "http://www.opensource.org/licenses/gpl-license.php", "http://www.gnu.org/copyleft/gpl.html"),
    "GPL-2.0": ("http://gnu.org/licenses/gpl-2.0.html", "http://www.gnu.org/licenses/old-licenses/gpl-2.0.html"),
    "LGPL-2.1": ("http://gnu.org/licenses/old-licenses/lgpl-2.1.html",),
    "Apache-2.0": ("http://www.apache.org/licenses/LICENSE-2.0", "http://opensource.org/licenses/apache2.0.php"),
    "MPL": ("http://www.mozilla.org/MPL/",),
    "MIT": ("http://www.opensource.org/licenses/mit-license.php",),
    "BSD": ("http://www.opensource.org/licenses/bsd-license.php",),
    "OpenOffice": ("http://www.openoffice.org/license.html",),
    "BitTorrent": ("http://www.bittorrent.com/license/",),
    "Tizen": ("http://www.tizenopensource.org/license",),
    "OpenSSL": ("http://www.openssl.org/source/license.html",),
    "BSL-1.0": ("http://www.boost.org/LICENSE_1_0.txt", "http://pocoproject.org/license.html"),
    "Zlib": ("http://www.zlib.net/zlib_license.html",),
    "jQuery": ("http://jquery.org/license",),
    "libxml": ("http://xmlsoft.org/FAQ.html#License",),
    "ICU": ("http://source.icu-project.org/repos/icu/icu/trunk/license.html",),
}
FORGE_MARKERS = {
    "sourceforge.net": ("sourceforge.net",),
    "freedesktop.org": ("http://cvs.freedesktop.org/", "http://cgit.freedesktop.org/"),
    "code.google.com": ("code.google.com", "googlecode.com"),
    "savannah.gnu.org": ("savannah.gnu.org/",),
    "github.com": ("github.com", "github.io"),
    "bitbucket.org": ("bitbucket.org",),
    "tigris.org": ("tigris.org",),
    "svn.apache.org": ("http://svn.apache.org/",),
    "launchpad.net": ("https://git.launchpad.net/", "launchpad.net"),
}
KERNEL_MARKERS = {"netfilter": ("Netfilter core team",), "squashfs": ("squashfs: version",), "sysfs": ("sysfs: could not get root inode",), "redboot": ("No RedBoot partition table detected in %s",), "mtd": ("add_mtd_device", "Can't allocate major number %d for Memory Technology Devices.")}

# The same licence verdict in the words of two scanners.
VERDICTS = {
    "No_license_found": "NONE", "GPL-1.0": "GPLv1", "GPL-1.0+": "GPLv1+", "GPL-2.0": "GPLv2", "GPL-2.0+": "GPLv2+", "GPL-3.0": "GPLv3", "GPL-3.0+": "GPLv3+", "LGPL-2.0": "LibraryGPLv2", "LGPL-2.0+": "LibraryGPLv2+",
    "LGPL-2.1": "LesserGPLv2.1", "LGPL-2.1+": "LesserGPLv2.1+", "LGPL-3.0": "LesserGPLv3", "LGPL-3.0+": "LesserGPLv3+", "Apache-1.0": "Apachev1.0", "Apache-1.1": "Apachev1.1", "Apache-2.0": "Apachev2", "BSL-1.0": "boostV1",
    "MPL-1.0": "MPLv1_0", "FTL": "FreeType", "PHP-3.01": "phpLicV3.01", "Postfix": "Postfix", "QPL-1.0": "QTv1", "MPL-1.1": "MPLv1_1", "Zend-2.0": "zendv2", "NPL-1.1": "NPLv1_1", "BSD-2-Clause": "spdxBSD2", "BSD-3-Clause": "spdxBSD3",
    "EPL-1.0": "EPLv1", "Artifex": "artifex", "CDDL": "CDDLic", "Public-domain": "publicDomain", "Public-domain-ref": "publicDomain", "IPL": "IBMv1", "Intel": "IntelACPILic", "MX4J-1.0": "MX4JLicensev1", "Beerware": "BeerWareVer42",
    "CPL-1.0": "CPLv1", "Sun": "sunRPC", "SunPro": "SunSimpleLic", "W3C-IP": "W3CLic", "Artistic-1.0": "ArtisticLicensev1",
}
