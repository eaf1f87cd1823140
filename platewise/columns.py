"""Column names and identifiers of the profile data model.

Fixed values: these names are the on-disk format of profile tables.
"""

META = "Metadata_"
SITE_KEY = "Metadata_Site_Key"
SOURCE = "Metadata_Source"
BATCH = "Metadata_Batch"
PLATE = "Metadata_Plate"
WELL = "Metadata_Well"
SITE = "Metadata_Site"
CHANNEL = "Metadata_Channel"
PERT = "Metadata_JCP2022"
GROUP = "Metadata_Group"
PERT_TYPE = "Metadata_Perturbation_Type"
PLATE_TYPE = "Metadata_PlateType"
SYMBOL = "Metadata_Symbol"
CONTROL_TYPE = "Metadata_control_type"
NEGCON = "Metadata_negcon"
TARGET_LIST = "Metadata_target_list"

SITE_PARTS = [SOURCE, BATCH, PLATE, WELL, SITE]
WELL_PARTS = [SOURCE, BATCH, PLATE, WELL]
PLATE_PARTS = [SOURCE, BATCH, PLATE]

UNKNOWN = "unknown"
FEATURES = "features"
ROW_ID = "row_id"
