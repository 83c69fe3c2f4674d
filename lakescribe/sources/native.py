"""Native catalog relations as they are landed, per dialect; every relation also has `source_id`.

What a server evaluates itself (type texts, default expressions, argument texts, property flags) is
landed as evaluated. Definitions and bodies are never landed, so no relation has a column for them.
"""

from __future__ import annotations

from pyspark.sql import types as T

_N = "decimal(38,0)"
_INFO = "line int, database_name string, version string"

NATIVE: dict[str, dict[str, str]] = {
    "postgresql": {
        "database_info": _INFO,
        "pg_namespace": "oid long, nspname string",
        "pg_class": "oid long, relname string, relnamespace long, relkind string, relam long, live_tuples long",
        "pg_description": "objoid long, objsubid int, classname string, description string",
        "pg_attribute": "attrelid long, attnum int, attname string, format_type string, attnotnull boolean, "
                        "attisdropped boolean",
        "pg_attrdef": "adrelid long, adnum int, expr_text string",
        "pg_index": "indexrelid long, indrelid long, indkey array<int>, indisunique boolean, indisprimary boolean",
        "pg_am": "oid long, amname string",
        "pg_constraint": "conname string, conrelid long, confrelid long, conkey array<int>, confkey array<int>, "
                         "contype string",
        "views": "table_schema string, table_name string, is_updatable string",
        "pg_proc": "oid long, proname string, pronamespace long, prokind string, identity_args string, "
                   "return_type string, prolang long",
        "pg_language": "oid long, lanname string",
        "pg_sequences": f"seqrelid long, seqmin {_N}, seqmax {_N}, seqincrement {_N}, last_value {_N}, seqcycle boolean",
        "pg_trigger": "oid long, tgname string, tgrelid long, tgtype int, tgenabled string, tgisinternal boolean",
    },
    "mysql": {
        "database_info": _INFO,
        "tables": "table_schema string, table_name string, table_type string, engine string, table_rows long, "
                  "table_comment string, create_time timestamp, update_time timestamp",
        "columns": "table_schema string, table_name string, column_name string, ordinal_position int, "
                   "data_type string, character_maximum_length long, numeric_precision int, numeric_scale int, "
                   "is_nullable string, column_default string, column_comment string, column_key string, extra string",
        "key_column_usage": "constraint_name string, table_schema string, table_name string, column_name string, "
                            "referenced_table_name string, referenced_column_name string",
        "statistics": "table_schema string, table_name string, index_name string, index_type string, "
                      "non_unique int, seq_in_index int, column_name string",
        "views": "table_schema string, table_name string, is_updatable string",
        "routines": "routine_schema string, routine_name string, routine_type string, routine_comment string, "
                    "dtd_identifier string",
        "parameters": "specific_schema string, specific_name string, routine_type string, parameter_name string, "
                      "ordinal_position int, parameter_mode string, data_type string",
        "triggers": "trigger_schema string, trigger_name string, event_object_schema string, "
                    "event_object_table string, action_timing string, event_manipulation string",
    },
    "oracle": {
        "database_info": _INFO,
        "all_tables": "owner string, table_name string, num_rows long, created timestamp, last_ddl_time timestamp",
        "all_tab_comments": "owner string, table_name string, comments string",
        "all_tab_columns": "owner string, table_name string, column_name string, column_id int, data_type string, "
                           "data_length int, data_precision int, data_scale int, nullable string, "
                           "data_default string, char_col_decl_length int",
        "all_col_comments": "owner string, table_name string, column_name string, comments string",
        "all_constraints": "owner string, constraint_name string, constraint_type string, table_name string, "
                           "r_owner string, r_constraint_name string",
        "all_cons_columns": "owner string, constraint_name string, table_name string, column_name string, position int",
        "all_indexes": "owner string, index_name string, table_owner string, table_name string, index_type string, "
                       "uniqueness string",
        "all_ind_comments": "owner string, index_name string, comments string",
        "all_ind_columns": "index_owner string, index_name string, column_name string, column_position int",
        "all_views": "owner string, view_name string, read_only string",
        "all_procedures": "owner string, object_name string, procedure_name string, object_type string, subprogram_id int",
        "all_arguments": "owner string, object_name string, package_name string, subprogram_id int, argument_name string, "
                         "position int, in_out string, data_type string, default_value string",
        "all_sequences": f"sequence_owner string, sequence_name string, min_value {_N}, max_value {_N}, "
                         f"increment_by {_N}, last_number {_N}, cache_size int, cycle_flag string, order_flag string",
        "all_triggers": "owner string, trigger_name string, table_owner string, table_name string, "
                        "trigger_type string, triggering_event string, status string",
        "all_synonyms": "owner string, synonym_name string, table_owner string, table_name string, db_link string",
    },
    "mssql": {
        "database_info": _INFO,
        "schemas": "schema_id int, name string",
        "tables": "object_id long, schema_id int, name string, type_desc string, create_date timestamp, "
                  "modify_date timestamp",
        "partitions": "object_id long, index_id int, rows long",
        # class: 1 for objects and columns, 7 for indexes
        "extended_properties": "class int, major_id long, minor_id int, name string, value string",
        "columns": "object_id long, column_id int, name string, user_type_id int, max_length int, precision int, "
                   "scale int, is_nullable boolean, is_identity boolean",
        "types": "user_type_id int, name string",
        "default_constraints": "parent_object_id long, parent_column_id int, default_text string",
        "indexes": "object_id long, index_id int, name string, type_desc string, is_unique boolean, "
                   "is_primary_key boolean",
        "index_columns": "object_id long, index_id int, column_id int, key_ordinal int",
        "foreign_keys": "object_id long, name string, parent_object_id long, referenced_object_id long",
        "foreign_key_columns": "constraint_object_id long, parent_object_id long, parent_column_id int, "
                               "referenced_column_id int",
        "views": "object_id long, schema_id int, name string, has_instead_of boolean",
        "procedures": "object_id long, schema_id int, name string, type_desc string",
        "parameters": "object_id long, parameter_id int, name string, is_output boolean, user_type_id int",
        "sequences": f"object_id long, schema_id int, name string, minimum_value {_N}, maximum_value {_N}, "
                     f"increment {_N}, current_value {_N}, is_cycling boolean",
        "triggers": "object_id long, parent_id long, name string, is_insert boolean, is_update boolean, "
                    "is_delete boolean, is_after boolean, is_instead_of boolean, is_disabled boolean, "
                    "is_ms_shipped boolean",
        "synonyms": "object_id long, schema_id int, name string, base_object_name string",
    },
}


def native_schema(dialect: str, relation: str) -> T.StructType:
    return T.StructType.fromDDL("source_id long, " + NATIVE[dialect][relation])
