"""Training-data operators: quality scoring and rules, licence scans, exact
and near duplicate removal, language identification, decontamination, chat
formatting, sharding and mixing.  Nothing else in the library imports this
subpackage."""
