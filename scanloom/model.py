"""Data model: tag codes and sets, value representations, transfer syntaxes.

The tables in this module are fixed values of the DICOM standard and of the
archive format; results depend on them being exactly these.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

ATTRIBUTE_TYPE = "struct<vr:string,Value:array<string>,InlineBinary:string,BulkDataURI:string>"
DATASET_TYPE = f"map<string,{ATTRIBUTE_TYPE}>"

# Keyword -> (tag, value representation).
TAGS: dict[str, tuple[str, str]] = {
    "SpecificCharacterSet": ("00080005", "CS"),
    "ImageType": ("00080008", "CS"),
    "InstanceCreationDate": ("00080012", "DA"),
    "InstanceCreationTime": ("00080013", "TM"),
    "SOPClassUID": ("00080016", "UI"),
    "SOPInstanceUID": ("00080018", "UI"),
    "StudyDate": ("00080020", "DA"),
    "SeriesDate": ("00080021", "DA"),
    "AcquisitionDate": ("00080022", "DA"),
    "ContentDate": ("00080023", "DA"),
    "StudyTime": ("00080030", "TM"),
    "SeriesTime": ("00080031", "TM"),
    "AcquisitionTime": ("00080032", "TM"),
    "ContentTime": ("00080033", "TM"),
    "AccessionNumber": ("00080050", "SH"),
    "Modality": ("00080060", "CS"),
    "ModalitiesInStudy": ("00080061", "CS"),
    "ConversionType": ("00080064", "CS"),
    "Manufacturer": ("00080070", "LO"),
    "InstitutionName": ("00080080", "LO"),
    "ReferringPhysicianName": ("00080090", "PN"),
    "StationName": ("00081010", "SH"),
    "StudyDescription": ("00081030", "LO"),
    "SeriesDescription": ("0008103E", "LO"),
    "OperatorsName": ("00081070", "PN"),
    "ManufacturerModelName": ("00081090", "LO"),
    "ReferencedSOPClassUID": ("00081150", "UI"),
    "ReferencedSOPInstanceUID": ("00081155", "UI"),
    "RetrieveURL": ("00081190", "UR"),
    "FailureReason": ("00081197", "US"),
    "FailedSOPSequence": ("00081198", "SQ"),
    "ReferencedSOPSequence": ("00081199", "SQ"),
    "PatientName": ("00100010", "PN"),
    "PatientID": ("00100020", "LO"),
    "IssuerOfPatientID": ("00100021", "LO"),
    "PatientBirthDate": ("00100030", "DA"),
    "PatientBirthTime": ("00100032", "TM"),
    "PatientSex": ("00100040", "CS"),
    "OtherPatientIDsSequence": ("00101002", "SQ"),
    "PatientIdentityRemoved": ("00120062", "CS"),
    "DeidentificationMethodCodeSequence": ("00120064", "SQ"),
    "BodyPartExamined": ("00180015", "CS"),
    "SecondaryCaptureDeviceID": ("00181010", "LO"),
    "DateOfSecondaryCapture": ("00181012", "DA"),
    "SecondaryCaptureDeviceManufacturer": ("00181016", "LO"),
    "SecondaryCaptureDeviceManufacturerModelName": ("00181018", "LO"),
    "SecondaryCaptureDeviceSoftwareVersions": ("00181019", "LO"),
    "SoftwareVersions": ("00181020", "LO"),
    "ProtocolName": ("00181030", "LO"),
    "PatientPosition": ("00185100", "CS"),
    "StudyInstanceUID": ("0020000D", "UI"),
    "SeriesInstanceUID": ("0020000E", "UI"),
    "StudyID": ("00200010", "SH"),
    "SeriesNumber": ("00200011", "IS"),
    "AcquisitionNumber": ("00200012", "IS"),
    "InstanceNumber": ("00200013", "IS"),
    "PatientOrientation": ("00200020", "CS"),
    "NumberOfStudyRelatedSeries": ("00201206", "IS"),
    "NumberOfStudyRelatedInstances": ("00201208", "IS"),
    "NumberOfSeriesRelatedInstances": ("00201209", "IS"),
    "SamplesPerPixel": ("00280002", "US"),
    "PhotometricInterpretation": ("00280004", "CS"),
    "PlanarConfiguration": ("00280006", "US"),
    "NumberOfFrames": ("00280008", "IS"),
    "Rows": ("00280010", "US"),
    "Columns": ("00280011", "US"),
    "BitsAllocated": ("00280100", "US"),
    "BitsStored": ("00280101", "US"),
    "HighBit": ("00280102", "US"),
    "PixelRepresentation": ("00280103", "US"),
    "SmallestImagePixelValue": ("00280106", "US"),
    "LargestImagePixelValue": ("00280107", "US"),
    "WindowCenter": ("00281050", "DS"),
    "WindowWidth": ("00281051", "DS"),
    "RescaleIntercept": ("00281052", "DS"),
    "RescaleSlope": ("00281053", "DS"),
    "WindowCenterWidthExplanation": ("00281055", "LO"),
    "StudyStatusID": ("0032000A", "CS"),
    "StudyPriorityID": ("0032000C", "CS"),
    "RequestedProcedureDescription": ("00321060", "LO"),
    "TransferSyntaxUID": ("00020010", "UI"),
    "PixelData": ("7FE00010", "OW"),
}

# Keyword lists of the query levels and of the shared extracts.
PATIENT_QUERY = [
    "PatientID", "OtherPatientIDsSequence", "PatientName", "IssuerOfPatientID", "PatientBirthDate",
    "PatientBirthTime", "PatientSex", "PatientIdentityRemoved", "DeidentificationMethodCodeSequence",
]
STUDY_QUERY = [
    "StudyDescription", "AccessionNumber", "StudyInstanceUID", "StudyDate", "StudyTime",
    "StudyStatusID", "StudyPriorityID", "StudyID",
]
SERIES_EXTRACT = [
    "SeriesDescription", "SeriesNumber", "SeriesInstanceUID", "Modality", "SeriesDate", "SeriesTime",
    "SpecificCharacterSet", "Manufacturer", "InstitutionName", "ReferringPhysicianName", "StationName",
    "OperatorsName", "ManufacturerModelName", "BodyPartExamined", "ProtocolName",
    "RequestedProcedureDescription",
]
INSTANCE_QUERY = [
    "SOPInstanceUID", "InstanceNumber", "SeriesInstanceUID", "StudyInstanceUID", "ContentDate",
    "ContentTime", "AcquisitionDate", "AcquisitionTime", "AcquisitionNumber", "SamplesPerPixel",
    "PhotometricInterpretation", "PlanarConfiguration", "Rows", "Columns", "BitsAllocated",
    "BitsStored", "HighBit", "PixelRepresentation", "WindowCenter", "WindowWidth",
    "WindowCenterWidthExplanation", "InstanceCreationTime",
]
IMAGE_EXTRACT = [
    "ImageType", "InstanceCreationDate", "SOPClassUID", "ConversionType", "ManufacturerModelName",
    "ContentDate", "AcquisitionDate", "SecondaryCaptureDeviceID", "DateOfSecondaryCapture",
    "SecondaryCaptureDeviceManufacturer", "SecondaryCaptureDeviceManufacturerModelName",
    "SecondaryCaptureDeviceSoftwareVersions", "SoftwareVersions", "SamplesPerPixel",
    "PhotometricInterpretation", "PlanarConfiguration", "Rows", "Columns", "BitsAllocated",
    "BitsStored", "HighBit", "PixelRepresentation", "WindowCenter", "WindowWidth",
    "WindowCenterWidthExplanation", "PatientPosition", "PatientOrientation",
]
PATIENT_STUDY_QUERY = PATIENT_QUERY + STUDY_QUERY
SERIES_QUERY = ["StudyInstanceUID"] + SERIES_EXTRACT

# Private tags of the de-duplication format and of store responses.
DEDUP_CREATOR = "dedupped"
DEDUP_REF = "00091010"
DEDUP_HASH = "00091011"
DEDUP_TYPE = "00091012"
CONTENT_LOCATION = "00091001"
ERROR_COMMENT = "00000902"
AVAILABLE_TRANSFER_SYNTAX = "00083002"

# Value representations that hold bytes.
BINARY_VRS = ["OB", "OD", "OF", "OL", "OV", "OW", "UN"]

# Value representations that hold numbers.
DECIMAL_VRS = ["DS", "FL", "FD"]
INTEGER_VRS = ["IS", "SS", "US", "SL", "UL"]

# Transfer syntax -> content type, extension, gzip, lossy, uncompressed.
TRANSFER_SYNTAXES: list[tuple[str, str, str | None, bool, bool, bool]] = [
    ("1.2.840.10008.1.2", "application/octet-stream", None, True, False, True),
    ("1.2.840.10008.1.2.1", "application/octet-stream", None, True, False, True),
    ("1.2.840.10008.1.2.1.99", "application/octet-stream", None, True, False, True),
    ("1.2.840.10008.1.2.2", "application/octet-stream", None, True, False, True),
    ("1.2.840.10008.1.2.4.50", "image/jpeg", ".jpeg", False, True, False),
    ("1.2.840.10008.1.2.4.51", "image/jpeg", None, False, True, False),
    ("1.2.840.10008.1.2.4.57", "image/jpeg", None, False, False, False),
    ("1.2.840.10008.1.2.4.70", "image/jll", ".jll", False, False, False),
    ("1.2.840.10008.1.2.4.80", "image/jls", ".jls", False, False, False),
    ("1.2.840.10008.1.2.4.81", "image/jls", None, False, True, False),
    ("1.2.840.10008.1.2.4.90", "image/jp2", ".jp2", False, False, False),
    ("1.2.840.10008.1.2.4.91", "image/jp2", None, False, False, False),
    ("1.2.840.10008.1.2.4.140", "image/x-jxl", ".jxl", False, False, False),
    ("1.2.840.10008.1.2.4.141", "image/x-jxl", None, False, True, False),
    ("1.2.840.10008.1.2.4.142", "image/x-jxl", None, False, True, False),
    ("1.2.840.10008.1.2.4.201", "image/jphc", None, False, False, False),
    ("1.2.840.10008.1.2.4.202", "image/jphc", ".jhc", False, False, False),
    ("1.2.840.10008.1.2.4.203", "image/jphc", None, False, True, False),
    ("1.2.840.10008.1.2.5", "image/dicom-rle", None, False, False, False),
    ("1.2.840.10008.1.2.8.1", "application/octet-stream", None, False, False, False),
    ("3.2.840.10008.1.2.4.96", "image/jphc", None, False, False, False),
]

# Plain little/big endian syntaxes share one canonical id.
EQUIVALENT_UNCOMPRESSED = ["1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"]
CANONICAL_UNCOMPRESSED = "1.2.840.10008.1.2.1"

# Video transfer syntax -> file type.
VIDEO_SYNTAXES: dict[str, str] = {
    "1.2.840.10008.1.2.4.100": "mpg",
    "1.2.840.10008.1.2.4.101": "mpg",
    "1.2.840.10008.1.2.4.102": "mp4",
    "1.2.840.10008.1.2.4.103": "mp4",
    "1.2.840.10008.1.2.4.104": "mp4",
    "1.2.840.10008.1.2.4.105": "mp4",
    "1.2.840.10008.1.2.4.106": "mp4",
    "1.2.840.10008.1.2.4.107": "h265",
    "1.2.840.10008.1.2.4.108": "h265",
}


Dictionary = Mapping[str, tuple[str, str]]


def load_dictionary(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """Keyword -> (tag, value representation) of a dictionary table with ``tag, vr, name``.

    The standard has a few thousand entries; the operators that take a ``dictionary`` put it into the plan as literals.
    The built-in tags are always known, whatever the table lacks.
    """
    rows = tag_dictionary(spark, path).where("name IS NOT NULL AND tag IS NOT NULL").select("name", "tag", "vr").collect()
    return {**{r["name"]: (r["tag"], r["vr"] or "UN") for r in rows}, **TAGS}


def tag(keyword: str, dictionary: Dictionary = TAGS) -> str:
    """Hex code of a keyword; hex codes pass through."""
    return dictionary[keyword][0] if keyword in dictionary else keyword


def codes(keywords: list[str]) -> list[str]:
    return [tag(k) for k in keywords]


def tag_dictionary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(tag, vr, vm, name)``: the core tags, or a full dictionary table at ``path``.

    The built-in table has a fixed size, so it may be broadcast. A site's complete
    dictionary is given as a parquet table with the same columns.
    """
    if path:
        return spark.read.parquet(path).select("tag", "vr", "vm", "name")
    rows = [(code, vr, "1", keyword) for keyword, (code, vr) in TAGS.items()]
    return spark.createDataFrame(rows, "tag string, vr string, vm string, name string")


def transfer_syntaxes(spark: SparkSession) -> DataFrame:
    """Fixed-size dimension of transfer syntaxes, including the video types."""
    rows = [(*row, None) for row in TRANSFER_SYNTAXES]
    rows += [(uid, None, None, False, False, False, kind) for uid, kind in VIDEO_SYNTAXES.items()]
    return spark.createDataFrame(
        rows,
        "transfer_syntax string, content_type string, extension string, gzip boolean, "
        "lossy boolean, uncompressed boolean, video_type string",
    )
