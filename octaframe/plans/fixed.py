"""Fixed values that the catalog is held against: the methods and their options."""

# Method, what it is, whether it has a bound, whether it has header facts, its flush.
METHODS_SQL = """SELECT * FROM (VALUES
    ('bcj', 'xz filters 4 to 11', true, false, 'none'),
    ('brotli', 'RFC 7932', true, true, 'none'),
    ('bzip2', 'bzip2', true, true, 'full'),
    ('deflate', 'RFC 1951', true, true, 'sync'),
    ('deflate64', 'ZIP method 9', true, false, 'none'),
    ('delta', 'xz filter 3', true, false, 'sync'),
    ('gzip', 'RFC 1952', true, true, 'sync'),
    ('implode', 'ZIP method 6', true, false, 'none'),
    ('lz4', 'LZ4 frame', true, true, 'full'),
    ('lzma', 'LZMA alone or raw', false, true, 'none'),
    ('lzma2', 'LZMA2 chunks', true, false, 'sync'),
    ('lzw', 'GIF and TIFF', true, true, 'full'),
    ('reduce', 'ZIP methods 2 to 5', true, false, 'none'),
    ('rle', 'PackBits and TGA', true, true, 'sync'),
    ('shrink', 'ZIP method 1', true, false, 'none'),
    ('xz', 'xz container', true, true, 'full'),
    ('zlib', 'RFC 1950', true, true, 'sync'),
    ('zstd', 'RFC 8878', true, true, 'full')
) t(method, spec, has_bound, has_peek, flush)"""

# Method, key, kind, default, least, most, allowed values.
OPTIONS_SQL = """SELECT * FROM (VALUES
    ('bcj', 'bcj.arch', 'string', 'x86', NULL, NULL, 'x86|powerpc|ia64|arm|armthumb|sparc|arm64|riscv'),
    ('bcj', 'bcj.start_offset', 'uint64', '0', '0', '4294967295', ''),
    ('bcj', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('brotli', 'brotli.lgwin', 'int64', '16', '10', '24', ''),
    ('brotli', 'brotli.level', 'int64', '1', '0', '5', ''),
    ('brotli', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('brotli', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('brotli', 'limits.max_expansion_ratio', 'uint64', '1290556', NULL, NULL, ''),
    ('brotli', 'limits.max_window_bytes', 'uint64', '16777216', NULL, NULL, ''),
    ('bzip2', 'bzip2.level', 'int64', '9', '1', '9', ''),
    ('bzip2', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('bzip2', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('bzip2', 'limits.max_expansion_ratio', 'uint64', '2500000', NULL, NULL, ''),
    ('bzip2', 'threads.count', 'uint64', '1', '0', NULL, ''),
    ('deflate', 'deflate.level', 'int64', '6', '0', '9', ''),
    ('deflate', 'deflate.window_bits', 'uint64', '15', '8', '15', ''),
    ('deflate', 'deflate.dictionary', 'bytes', NULL, NULL, NULL, ''),
    ('deflate', 'deflate.strategy', 'string', 'default', NULL, NULL, 'default|lazy|huffman_only|rle|fixed'),
    ('deflate', 'limits.max_output_bytes', 'uint64', '536870912', NULL, NULL, ''),
    ('deflate', 'limits.max_memory_bytes', 'uint64', '268435456', NULL, NULL, ''),
    ('deflate', 'limits.max_expansion_ratio', 'uint64', '1032', NULL, NULL, ''),
    ('deflate', 'limits.max_window_bytes', 'uint64', '32768', NULL, NULL, ''),
    ('deflate64', 'deflate64.level', 'int64', '6', '0', '9', ''),
    ('deflate64', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('deflate64', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('deflate64', 'limits.max_expansion_ratio', 'uint64', '29128', NULL, NULL, ''),
    ('delta', 'delta.distance', 'int64', '1', '1', '256', ''),
    ('delta', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('gzip', 'gzip.mtime', 'uint64', '0', '0', '4294967295', ''),
    ('gzip', 'gzip.os', 'uint64', '255', '0', '255', ''),
    ('gzip', 'gzip.name', 'string', NULL, NULL, NULL, ''),
    ('gzip', 'gzip.comment', 'string', NULL, NULL, NULL, ''),
    ('gzip', 'gzip.extra', 'bytes', NULL, NULL, NULL, ''),
    ('gzip', 'gzip.header_crc', 'bool', 'false', NULL, NULL, ''),
    ('gzip', 'gzip.text', 'bool', 'false', NULL, NULL, ''),
    ('gzip', 'gzip.xfl', 'uint64', NULL, '0', '255', ''),
    ('gzip', 'gzip.header_flags', 'uint64', NULL, '0', '255', ''),
    ('gzip', 'gzip.concat', 'bool', 'false', NULL, NULL, ''),
    ('gzip', 'gzip.max_name_bytes', 'uint64', '1048576', '1', NULL, ''),
    ('gzip', 'gzip.max_comment_bytes', 'uint64', '1048576', '1', NULL, ''),
    ('gzip', 'gzip.max_extra_bytes', 'uint64', '65536', '1', NULL, ''),
    ('gzip', 'deflate.level', 'int64', '6', '0', '9', ''),
    ('gzip', 'deflate.window_bits', 'uint64', '15', '8', '15', ''),
    ('gzip', 'deflate.dictionary', 'bytes', NULL, NULL, NULL, ''),
    ('gzip', 'deflate.strategy', 'string', 'default', NULL, NULL, 'default|lazy|huffman_only|rle|fixed'),
    ('gzip', 'limits.max_output_bytes', 'uint64', '536870912', NULL, NULL, ''),
    ('gzip', 'limits.max_memory_bytes', 'uint64', '268435456', NULL, NULL, ''),
    ('gzip', 'limits.max_expansion_ratio', 'uint64', '1032', NULL, NULL, ''),
    ('implode', 'implode.dictionary_size', 'uint64', '8192', NULL, NULL, ''),
    ('implode', 'implode.literal_tree', 'bool', 'true', NULL, NULL, ''),
    ('implode', 'implode.uncompressed_size', 'uint64', '0', NULL, NULL, ''),
    ('implode', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('implode', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('implode', 'limits.max_expansion_ratio', 'uint64', '152', NULL, NULL, ''),
    ('lz4', 'lz4.block_size', 'uint64', '4194304', '65536', '4194304', ''),
    ('lz4', 'lz4.block_checksum', 'bool', 'false', NULL, NULL, ''),
    ('lz4', 'lz4.content_checksum', 'bool', 'false', NULL, NULL, ''),
    ('lz4', 'lz4.independent_blocks', 'bool', 'true', NULL, NULL, ''),
    ('lz4', 'lz4.concat', 'bool', 'false', NULL, NULL, ''),
    ('lz4', 'lz4.dictionary', 'bytes', NULL, NULL, NULL, ''),
    ('lz4', 'lz4.dictionary_id', 'uint64', NULL, '0', '4294967295', ''),
    ('lz4', 'lz4.content_size', 'uint64', NULL, NULL, NULL, ''),
    ('lz4', 'limits.max_block_bytes', 'uint64', '4194304', NULL, NULL, ''),
    ('lz4', 'limits.max_output_bytes', 'uint64', '536870912', NULL, NULL, ''),
    ('lz4', 'limits.max_memory_bytes', 'uint64', '268435456', NULL, NULL, ''),
    ('lz4', 'limits.max_expansion_ratio', 'uint64', '255', NULL, NULL, ''),
    ('lz4', 'threads.count', 'uint64', '1', '0', NULL, ''),
    ('lzma', 'lzma.raw', 'bool', 'false', NULL, NULL, ''),
    ('lzma', 'lzma.preset', 'int64', '6', '0', '9', ''),
    ('lzma', 'lzma.lc', 'int64', '3', '0', '8', ''),
    ('lzma', 'lzma.lp', 'int64', '0', '0', '4', ''),
    ('lzma', 'lzma.pb', 'int64', '2', '0', '4', ''),
    ('lzma', 'lzma.dict_size', 'uint64', '8388608', '4096', '4294967295', ''),
    ('lzma', 'lzma.uncompressed_size', 'uint64', '18446744073709551615', NULL, NULL, ''),
    ('lzma', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('lzma', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('lzma', 'limits.max_expansion_ratio', 'uint64', '8192', NULL, NULL, ''),
    ('lzma', 'limits.max_window_bytes', 'uint64', '1610612736', NULL, NULL, ''),
    ('lzma2', 'lzma2.preset', 'int64', '6', '0', '9', ''),
    ('lzma2', 'lzma2.lc', 'int64', '3', '0', '4', ''),
    ('lzma2', 'lzma2.lp', 'int64', '0', '0', '4', ''),
    ('lzma2', 'lzma2.pb', 'int64', '2', '0', '4', ''),
    ('lzma2', 'lzma2.dict_size', 'uint64', '8388608', '4096', '4294967295', ''),
    ('lzma2', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('lzma2', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('lzma2', 'limits.max_expansion_ratio', 'uint64', '8192', NULL, NULL, ''),
    ('lzma2', 'limits.max_window_bytes', 'uint64', '1610612736', NULL, NULL, ''),
    ('lzw', 'lzw.format', 'string', 'gif', NULL, NULL, 'gif|tiff'),
    ('lzw', 'lzw.lit_width', 'uint64', NULL, NULL, NULL, ''),
    ('lzw', 'lzw.max_code_bits', 'uint64', '12', '9', '12', ''),
    ('lzw', 'lzw.encoder_lookup', 'string', 'hash', NULL, NULL, 'linear|hash'),
    ('lzw', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('lzw', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('lzw', 'limits.max_expansion_ratio', 'uint64', '2560', NULL, NULL, ''),
    ('reduce', 'reduce.factor', 'int64', '4', '1', '4', ''),
    ('reduce', 'reduce.uncompressed_size', 'uint64', '0', NULL, NULL, ''),
    ('reduce', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('reduce', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('reduce', 'limits.max_expansion_ratio', 'uint64', '1024', NULL, NULL, ''),
    ('rle', 'rle.format', 'string', 'packbits', NULL, NULL, 'packbits|tga'),
    ('rle', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('rle', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('rle', 'limits.max_expansion_ratio', 'uint64', '64', NULL, NULL, ''),
    ('shrink', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('shrink', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('shrink', 'limits.max_expansion_ratio', 'uint64', '7282', NULL, NULL, ''),
    ('xz', 'xz.preset', 'int64', '6', '0', '9', ''),
    ('xz', 'xz.lc', 'int64', '3', '0', '4', ''),
    ('xz', 'xz.lp', 'int64', '0', '0', '4', ''),
    ('xz', 'xz.pb', 'int64', '2', '0', '4', ''),
    ('xz', 'xz.dict_size', 'uint64', '0', NULL, NULL, ''),
    ('xz', 'xz.check', 'string', 'crc64', NULL, NULL, 'none|crc32|crc64|sha256'),
    ('xz', 'xz.block_size', 'uint64', '0', NULL, NULL, ''),
    ('xz', 'xz.filters', 'string', '', NULL, NULL, ''),
    ('xz', 'limits.max_output_bytes', 'uint64', '0', NULL, NULL, ''),
    ('xz', 'limits.max_memory_bytes', 'uint64', '0', NULL, NULL, ''),
    ('xz', 'limits.max_expansion_ratio', 'uint64', '8192', NULL, NULL, ''),
    ('xz', 'limits.max_window_bytes', 'uint64', '1610612736', NULL, NULL, ''),
    ('xz', 'threads.count', 'uint64', '1', '0', NULL, ''),
    ('zlib', 'zlib.dictionary', 'bytes', NULL, NULL, NULL, ''),
    ('zlib', 'deflate.level', 'int64', '6', '0', '9', ''),
    ('zlib', 'deflate.window_bits', 'uint64', '15', '8', '15', ''),
    ('zlib', 'deflate.dictionary', 'bytes', NULL, NULL, NULL, ''),
    ('zlib', 'deflate.strategy', 'string', 'default', NULL, NULL, 'default|lazy|huffman_only|rle|fixed'),
    ('zlib', 'limits.max_output_bytes', 'uint64', '536870912', NULL, NULL, ''),
    ('zlib', 'limits.max_memory_bytes', 'uint64', '268435456', NULL, NULL, ''),
    ('zlib', 'limits.max_expansion_ratio', 'uint64', '1032', NULL, NULL, ''),
    ('zstd', 'zstd.level', 'int64', '3', '0', '22', ''),
    ('zstd', 'zstd.checksum', 'bool', 'false', NULL, NULL, ''),
    ('zstd', 'zstd.seekable', 'bool', 'false', NULL, NULL, ''),
    ('zstd', 'zstd.seekable_frame_size', 'uint64', '1048576', '1024', '2147483647', ''),
    ('zstd', 'zstd.seekable_checksum', 'bool', 'true', NULL, NULL, ''),
    ('zstd', 'zstd.long', 'bool', 'false', NULL, NULL, ''),
    ('zstd', 'zstd.ldm_min_match', 'uint64', '64', '16', '4096', ''),
    ('zstd', 'zstd.ldm_hash_log', 'uint64', '0', '0', '30', ''),
    ('zstd', 'zstd.ldm_hash_rate_log', 'uint64', '6', '0', '12', ''),
    ('zstd', 'zstd.window_log', 'uint64', '0', '0', '31', ''),
    ('zstd', 'zstd.content_size', 'uint64', NULL, NULL, NULL, ''),
    ('zstd', 'zstd.concat', 'bool', 'true', NULL, NULL, ''),
    ('zstd', 'zstd.dictionary', 'bytes', NULL, NULL, NULL, ''),
    ('zstd', 'zstd.dictionary_id', 'uint64', NULL, NULL, NULL, ''),
    ('zstd', 'zstd.job_size', 'uint64', '0', '0', '16777216', ''),
    ('zstd', 'limits.max_output_bytes', 'uint64', '536870912', NULL, NULL, ''),
    ('zstd', 'limits.max_memory_bytes', 'uint64', '268435456', NULL, NULL, ''),
    ('zstd', 'limits.max_expansion_ratio', 'uint64', '32768', NULL, NULL, ''),
    ('zstd', 'limits.max_window_bytes', 'uint64', '134217728', NULL, NULL, ''),
    ('zstd', 'threads.count', 'uint64', '1', '0', NULL, '')
) t(method, key, kind, default_value, least, most, allowed)"""
