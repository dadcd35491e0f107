"""The record classes: id field, XML and JSON names, time column and declared schema."""

from __future__ import annotations

from dataclasses import dataclass

# Authorities, and per class the id field, container, XML root.
AUTHORITIES = ("NFB", "THB", "TNN")
_CLASSES = """
VD               VDID               VDs               VDList
VDLive           VDID               VDLives           VDLiveList
CCTV             CCTVID             CCTVs             CCTVList
CMS              CMSID              CMSs              CMSList
CMSLive          CMSID              CMSLives          CMSLiveList
AVI              AVIID              AVIs              AVIList
AVIPair          AVIPairID          AVIPairs          AVIPairList
AVIPairLive      AVIPairID          AVIPairs          AVIPairList
ETag             ETagGantryID       ETags             ETagList
ETagPair         ETagPairID         ETagPairs         ETagPairList
ETagPairLive     ETagPairID         ETagPairLives     ETagPairLiveList
GVPLiveTraffic   SectionID          GVPLiveTraffics   GVPLiveTrafficList
CVPLiveTraffic   SectionID          CVPLiveTraffics   CVPLiveTrafficList
Section          SectionID          Sections          SectionList
SectionLink      SectionID          SectionLinks      SectionLinkList
LiveTraffic      SectionID          LiveTraffics      LiveTrafficList
CongestionLevel  CongestionLevelID  CongestionLevels  CongestionLevelList
SectionShape     SectionID          SectionShapes     SectionShapeList
News             NewsID             Newses            NewsList
"""

VDLIVE_LINKS = (
    "array<struct<LinkID: string, Lanes: array<struct<Speed: double, Occupancy: double, "
    "Vehicles: array<struct<VehicleType: string, Volume: bigint, Speed: double>>>>>>"
)
FLOW_LINKS = "array<struct<LinkID: string, Volume: double, Speed: double, Occupancy: double>>"

# Typed fields known beyond the id and the time, per class.
_KNOWN_FIELDS = {
    "VD": "SubAuthorityCode string, DetectionLinks array<map<string,string>>",
    "VDLive": f"SubAuthorityCode string, Status string, LinkFlows {VDLIVE_LINKS}",
    "AVIPair": "SubAuthorityCode string, LinkIDs array<struct<LinkID: string>>",
    "ETagPair": "SubAuthorityCode string, LinkIDs array<struct<LinkID: string>>",
    "ETagPairLive": "Flows array<map<string,string>>",
    "CongestionLevel": "SubAuthorityCode string, Description string, Levels array<map<string,string>>",
    "News": (
        "SubAuthorityCode string, Department string, NewsURL string, AttachmentURL string, "
        "StartTime string, EndTime string"
    ),
    "CMSLive": "",
    "AVIPairLive": "",
    "LiveTraffic": "",
}


@dataclass(frozen=True)
class RecordClass:
    name: str
    id_field: str
    container: str
    root: str

    @property
    def is_live(self) -> bool:
        return "Live" in self.name

    @property
    def time_field(self) -> str:
        return "DataCollectTime" if self.is_live else "UpdateTime"

    @property
    def key(self) -> tuple[str, str]:
        return (self.id_field, self.time_field)

    @property
    def schema(self) -> str:
        """DDL of the stored table; fields not declared here travel in ``extra`` as JSON text."""
        known = _KNOWN_FIELDS.get(self.name, "SubAuthorityCode string")
        head = f"{self.id_field} string, {self.time_field} timestamp"
        return ", ".join(part for part in (head, known, "extra map<string,string>") if part)


CLASSES = {name: RecordClass(name, *rest) for name, *rest in map(str.split, _CLASSES.strip().splitlines())}

# News carries its own UpdateTime and is uploaded like a live record.
LIVE_UPLOAD = tuple(c.name for c in CLASSES.values() if c.is_live or c.name == "News")
STATIC_UPLOAD = tuple(name for name in CLASSES if name not in LIVE_UPLOAD)


def record_class(name: str, allowed=None) -> RecordClass:
    if name not in CLASSES or (allowed is not None and name not in allowed):
        raise ValueError(f"unknown record class {name!r}; expected one of {sorted(allowed or CLASSES)}")
    return CLASSES[name]


def authority(name: str) -> str:
    if name not in AUTHORITIES:
        raise ValueError(f"unknown authority {name!r}; expected one of {AUTHORITIES}")
    return name
