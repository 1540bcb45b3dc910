"""The codes of findings, as one small table that never grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each code and its name.
CODES = """
FLOWCLI_MENU_REQUIRES_INTERACTIVE RequiresInteractiveTerminal
FLOWCLI_PRESENTATION_FAILED PresentationFailed
FLOWCLI_INTERACTIVE_INPUT_UNAVAILABLE InteractiveInputUnavailable
FLOW_JSON_INVALID InvalidJson
FLOW_JSON_INVALID_DOCUMENT InvalidDocument
FLOW_JSON_UNSUPPORTED_FORMAT UnsupportedFormat
FLOW_JSON_UNSUPPORTED_NODE UnsupportedNode
FLOW_DUPLICATE_NODE_ID DuplicateNodeId
FLOW_INVALID_NODE_ID InvalidNodeId
FLOW_INVALID_HIERARCHY InvalidHierarchy
FLOW_INVALID_HEADING_LEVEL InvalidHeadingLevel
FLOW_MISSING_FIGURE_ASSET MissingFigureAsset
FLOW_INVALID_COVER_FIGURE InvalidCoverFigure
FLOW_INVALID_ANCHOR InvalidAnchor
FLOW_UNRESOLVED_ANCHOR UnresolvedAnchor
FLOW_UNRESOLVED_FOOTNOTE_REFERENCE UnresolvedFootnoteReference
FLOW_INVALID_TOC_TARGET InvalidTableOfContentsTarget
FLOW_UNRESOLVED_TABLE_HEADER_REFERENCE UnresolvedTableHeaderReference
FLOW_INVALID_LANGUAGE_TAG InvalidLanguageTag
FLOW_INVALID_BIDIRECTIONAL_STRUCTURE InvalidBidirectionalStructure
FLOW_INVALID_RUBY_STRUCTURE InvalidRubyStructure
EPC034 ToolMissing
EPC035 IncompatibleVersion
EPC036 Timeout
EPC037 OutputLimitExceeded
EPC038 UnrecognizedOutput
EPC039 ToolFailure
EPC020 DiscoveryUnavailable
EPC021 InspectionFailed
EPC022 UnexpectedEpubVersion
EPC023 ImportFailed
EPC024 ValidationFailed
EPC025 FidelityFailed
EPC026 RoundTripFailed
EPC027 IdentityMismatch
EPC028 CanonicalHashMismatch
EPC029 LayoutFailed
EPC030 HtmlPackageFailed
EPC031 ExpectationFailed
EPC032 UnsupportedExpectation
EPC033 ProcessingFailed
ELG001 CandidateMismatch
ELG002 LegalUseNotDeclared
ELG003 DrmFreeNotDeclared
ELG004 SourceUnavailable
ELG005 SourceLimitExceeded
ELG006 SourceHashMismatch
ELG007 InspectionFailed
ELG008 ImportFailed
ELG009 FidelityFailed
ELG010 FidelityLoss
ELG011 ValidationFailed
ELG012 SerializationFailed
ELG013 IdentityMismatch
ELG014 CanonicalHashMismatch
ELG015 SemanticOrderMismatch
ELG016 LayoutFailed
ELG017 HtmlPackageFailed
ELG018 NonDeterministicResult
ELG019 StructuralAuditPending
ELG020 HumanReviewPending
ELG021 EssentialReferenceBroken
ELG022 EssentialReferenceAmbiguous
ELG023 ReferenceApproximated
EPL001 LegalUseNotDeclared
EPL002 DrmFreeNotDeclared
EPL003 CandidateInsideRepository
EPL004 CandidateUnavailable
EPL005 CandidatePathUnsafe
EPL006 ArchiveLimitExceeded
EPL007 InspectionFailed
EPL008 UnknownEpubVersion
EPL009 MissingReadingOrder
EPL010 MissingXhtml
EPL011 MissingNavigation
EPL012 InsufficientLengthEvidence
EPL013 InsufficientResourceVariety
EPL014 NoSuitableCandidate
EPM001 AutomaticApprovalCode
EPM002 FidelityLossCode
EPM003 MissingFailureEvidenceCode
EPM004 HumanReviewCode
EPM005 NondeterminismCode
EPI001 SearchLimitExceeded
EPI002 UnsafeFileSystemEntry
EPI003 CandidateUnreadable
EPI004 ArchiveLimitExceeded
EPI005 InspectionFailed
EPI006 UnknownEpubVersion
EPI007 MissingReadingOrder
EPI008 UnsupportedEncryption
EPI009 RightsMetadataPresent
EPI010 FontObfuscationPresent
EPI011 InvalidProtectionMetadata
EPI012 DuplicateContent
EPI013 UnsupportedResources
FLOW_EPUB_CORPUS_PATH ExternalCorpusEnvironmentVariable
EPC013 Missing
EPC014 HashMismatch
EPC015 LicenseRejected
EPC016 UnsafePath
EPC017 ExternalDirectoryUnavailable
EPC018 TemporaryCopyFailed
EPC019 SearchLimitExceeded
EPC001 InvalidJson
EPC002 InvalidEncoding
EPC003 UnsupportedFormat
EPC004 MissingRequiredValue
EPC005 DuplicatePublicationId
EPC006 InvalidPublicationId
EPC007 InvalidSha256
EPC008 UnsupportedEpubVersion
EPC009 UnsafeRelativePath
EPC010 InvalidLicense
EPC011 InvalidValue
EPC012 UnknownProperty
EPUB001 InvalidArchive
EPUB002 ArchiveLimitExceeded
EPUB003 UnsafePath
EPUB004 MissingContainer
EPUB005 InvalidXml
EPUB006 MissingPackage
EPUB007 InvalidPackage
EPUB008 MissingResource
EPUB009 UnsupportedResource
EPUB010 UnsupportedElement
EPUB011 InvalidReference
EPUB012 MetadataFallback
EPUB013 NonLinearSpineItem
EPUB014 DocumentValidation
EPUB015 UnsupportedVersion
EPUB016 MultipleTableOfContents
EPUB017 InvalidTableOfContents
EPUB018 MissingTableOfContentsTarget
EPUB019 EmptyTableOfContentsEntry
EPUB020 InvalidTableOfContentsLevel
EPUB021 CircularTableOfContentsReference
EPUB022 TableOfContentsConflict
EPUB023 InvalidMetadata
EPUB024 OrphanMetadataRefinement
EPUB025 MetadataConflict
EPUB026 InvalidLanguage
EPUB027 MissingIdentifier
EPUB028 CircularFallback
EPUB029 BrokenFallback
EPUB030 RepeatedSpineItem
EPUB031 UnsupportedMediaOverlay
EPUB032 InvalidSpineLinearity
EPUB033 DuplicateManifestResource
EPUB034 DuplicateSourceId
EPUB035 InvalidSourceId
EPUB036 SourceIdCollision
EPUB037 UnmappedSourceLocation
EPUB038 InvalidImageData
EPUB039 ImageMediaTypeMismatch
EPUB040 ImageDimensionsExceeded
EPUB041 MissingImageAlternativeText
EPUB042 UnsupportedImageFormat
EPUB043 UnsafeSvg
EPUB044 ImageFallbackUsed
EPUB045 ImageDeduplicated
EPUB046 ImageBytesExceeded
EPUB047 InvalidStylesheet
EPUB048 UnsupportedCssSelector
EPUB049 UnsupportedCssProperty
EPUB062 SanitizedSvg
EPUB063 MathSemanticLoss
EPUB064 InvalidTextDirection
EPUB065 ConflictingInlineLanguage
EPUB066 InvalidRubyStructure
EPUB067 InvalidSvgImageReference
EPUB068 SvgImageFallbackUsed
EPUB069 SvgImageSemanticLoss
EPUB070 UnsupportedManifestProperty
EPUB071 HeadingLevelNormalized
EPUB072 NoteResourceFallbackUsed
EPUB073 LinkedImageTargetNotRepresentable
EPUB074 EmbeddedFontBytesNotPreserved
EPUB075 TransparentContainerTransformed
EPUB076 LegacyPageMapNotImported
EPUB077 ArchivePathCaseMismatchRecovered
EPUB078 CssImageResourceNotPreserved
EPUB079 ImageAlternativeTextRecovered
EPUB080 TableColumnMetadataNotRepresented
EPUB050 InvalidCssValue
EPUB051 ExternalStylesheetBlocked
EPUB052 CssTargetNotRepresentable
EPUB053 OrphanNoteReference
EPUB054 UnreferencedNote
EPUB055 MissingNoteBacklink
EPUB056 CircularNoteReference
EPUB057 AmbiguousNoteDestination
EPUB058 InvalidTableStructure
EPUB059 InvalidTableSpan
EPUB060 InvalidTableScope
EPUB061 MissingTableHeader
"""


def diagnostic_codes(spark: SparkSession) -> DataFrame:
    """code, name, family: the family is the letters a code begins with."""
    rows = [tuple(line.split()) for line in CODES.strip().splitlines()]
    return spark.createDataFrame(rows, "code string, name string").withColumn("family", F.regexp_extract("code", "^([A-Z]+)", 1))
