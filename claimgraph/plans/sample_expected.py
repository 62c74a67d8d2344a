"""What queries over the sample corpus must return: recorded from a run after the rows had been looked through against the
sample's source, so they guard against change, and are no second implementation. Tests hold those that `sample_queries` names an
outcome for against that outcome. Columns are (name, type) in the order of the rows."""

from __future__ import annotations

# Expected rows by query.
EXPECTED: dict[str, tuple[list[tuple[str, str]], list[tuple]]] = {
    "compile_artifacts": (
        [('rel_path', 'string'), ('language', 'string'), ('status', 'string')],
        [
            ('binary.py', 'python', 'SKIPPED'),
            ('broken.py', 'python', 'FAILED'),
            ('data/limits.csv', 'csv', 'UNSUPPORTED'),
            ('data/limits.json', 'json', 'UNSUPPORTED'),
            ('data/limits.xml', 'xml', 'UNSUPPORTED'),
            ('empty.py', 'python', 'OK'),
            ('ignore.py', 'python', 'OK'),
            ('latin.py', 'python', 'SKIPPED'),
            ('notes.md', 'markdown', 'UNSUPPORTED'),
            ('src/shop/__init__.py', 'python', 'OK'),
            ('src/shop/core.py', 'python', 'OK'),
            ('src/shop/use.py', 'python', 'OK'),
            ('src/shop/util.py', 'python', 'OK'),
            ('tools/run.py', 'python', 'OK'),
            ('tools/twin.py', 'python', 'OK'),
        ],
    ),
    "compile_symbols": (
        [('rel_path', 'string'), ('kind', 'string'), ('qname', 'string'), ('line_start', 'int'), ('parent', 'string'), ('parent_line', 'int')],
        [
            ('empty.py', 'module', 'empty', 1, None, None),
            ('ignore.py', 'module', 'ignore', 1, None, None),
            ('src/shop/__init__.py', 'module', 'shop', 1, None, None),
            ('src/shop/core.py', 'class', 'shop.core.Base', 10, 'shop.core', 1),
            ('src/shop/core.py', 'class', 'shop.core.Cart', 14, 'shop.core', 1),
            ('src/shop/core.py', 'constant', 'shop.core.Cart.NAME', 17, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'constant', 'shop.core.Cart.NEGATIVE', 23, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'constant', 'shop.core.Cart.NESTED', 28, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'constant', 'shop.core.Cart.NOTHING', 20, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'constant', 'shop.core.Cart.OPEN', 19, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'constant', 'shop.core.Cart.RATIO', 18, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'constant', 'shop.core.Cart.RAW', 22, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'constant', 'shop.core.Cart.TIMEOUT', 16, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'constant', 'shop.core.Cart.WAIT', 21, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'constant', 'shop.core.LIMIT', 6, 'shop.core', 1),
            ('src/shop/core.py', 'function', 'shop.core.Cart.items.inner', 35, 'shop.core.Cart.items', 34),
            ('src/shop/core.py', 'function', 'shop.core.clamp_all', 49, 'shop.core', 1),
            ('src/shop/core.py', 'function', 'shop.core.helper', 44, 'shop.core', 1),
            ('src/shop/core.py', 'function', 'shop.core.price', 40, 'shop.core', 1),
            ('src/shop/core.py', 'method', 'shop.core.Cart.items', 34, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'method', 'shop.core.Cart.total', 30, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'module', 'shop.core', 1, None, None),
            ('src/shop/core.py', 'variable', 'shop.core.Cart.a', 24, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'variable', 'shop.core.Cart.b', 24, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'variable', 'shop.core.Cart.typed', 26, 'shop.core.Cart', 14),
            ('src/shop/core.py', 'variable', 'shop.core.clamp_all.local', 50, 'shop.core.clamp_all', 49),
            ('src/shop/core.py', 'variable', 'shop.core.naïve', 7, 'shop.core', 1),
            ('src/shop/use.py', 'class', 'shop.use.Shop', 22, 'shop.use', 1),
            ('src/shop/use.py', 'function', 'shop.use.run', 10, 'shop.use', 1),
            ('src/shop/use.py', 'method', 'shop.use.Shop.total', 23, 'shop.use.Shop', 22),
            ('src/shop/use.py', 'module', 'shop.use', 1, None, None),
            ('src/shop/util.py', 'function', 'shop.util.clamp', 1, 'shop.util', 1),
            ('src/shop/util.py', 'function', 'shop.util.twice', 6, 'shop.util', 1),
            ('src/shop/util.py', 'function', 'shop.util.twice', 9, 'shop.util', 1),
            ('src/shop/util.py', 'module', 'shop.util', 1, None, None),
            ('tools/run.py', 'class', 'run.Signer', 5, 'run', 1),
            ('tools/run.py', 'constant', 'run.Signer.MODE', 6, 'run.Signer', 5),
            ('tools/run.py', 'function', 'run.run', 1, 'run', 1),
            ('tools/run.py', 'module', 'run', 1, None, None),
            ('tools/twin.py', 'class', 'twin.Signer', 1, 'twin', 1),
            ('tools/twin.py', 'constant', 'twin.Signer.MODE', 2, 'twin.Signer', 1),
            ('tools/twin.py', 'constant', 'twin.Signer.MODE', 3, 'twin.Signer', 1),
            ('tools/twin.py', 'function', 'twin.first', 6, 'twin', 1),
            ('tools/twin.py', 'function', 'twin.first.work', 7, 'twin.first', 6),
            ('tools/twin.py', 'function', 'twin.second', 12, 'twin', 1),
            ('tools/twin.py', 'function', 'twin.second.work', 13, 'twin.second', 12),
            ('tools/twin.py', 'module', 'twin', 1, None, None),
        ],
    ),
    "compile_calls": (
        [('subject', 'string'), ('to_name', 'string'), ('object', 'string'), ('resolution', 'string'), ('claims', 'bigint')],
        [
            ('shop.core.Cart.items', 'inner', None, 'UNRESOLVED', 1),
            ('shop.core.Cart.items.inner', 'util.clamp', 'shop.util.clamp', 'DETERMINISTIC', 1),
            ('shop.core.Cart.total', 'clamp', 'shop.util.clamp', 'DETERMINISTIC', 1),
            ('shop.core.Cart.total', 'price', 'shop.core.price', 'DETERMINISTIC', 1),
            ('shop.core.clamp_all', 'clamp', 'shop.util.clamp', 'DETERMINISTIC', 1),
            ('shop.core.clamp_all', 'helper.x', None, 'UNRESOLVED', 1),
            ('shop.core.clamp_all', 'missing', None, 'UNRESOLVED', 1),
            ('shop.core.clamp_all', 'self.run', None, 'UNRESOLVED', 1),
            ('shop.core.helper', 'os.path.join', None, 'UNRESOLVED', 1),
            ('shop.core.price', '<computed>', None, 'UNRESOLVED', 1),
            ('shop.core.price', 'helper', 'shop.core.helper', 'DETERMINISTIC', 1),
            ('shop.use.Shop.total', 'run', 'shop.use.run', 'DETERMINISTIC', 1),
            ('shop.use.run', 'Basket', None, 'UNRESOLVED', 1),
            ('shop.use.run', 'absent', None, 'UNRESOLVED', 1),
            ('shop.use.run', 'c.Cart.total', 'shop.core.Cart.total', 'DETERMINISTIC', 1),
            ('shop.use.run', 'c.nowhere', None, 'UNRESOLVED', 1),
            ('shop.use.run', 'c.price', 'shop.core.price', 'DETERMINISTIC', 1),
            ('shop.use.run', 'price', 'shop.core.price', 'HEURISTIC', 1),
            ('shop.use.run', 'shop.core.helper', 'shop.core.helper', 'DETERMINISTIC', 1),
            ('shop.use.run', 'thing', None, 'UNRESOLVED', 1),
            ('shop.use.run', 'twice', None, 'UNRESOLVED', 1),
            ('shop.util.twice', 'clamp', 'shop.util.clamp', 'DETERMINISTIC', 2),
            ('twin.first', 'work', None, 'UNRESOLVED', 1),
            ('twin.second', 'work', None, 'UNRESOLVED', 1),
        ],
    ),
    "compile_imports": (
        [('predicate', 'string'), ('subject', 'string'), ('to_name', 'string'), ('object', 'string'), ('resolution', 'string'), ('claims', 'bigint')],
        [
            ('EXTENDS', 'shop.core.Cart', 'Base', None, 'UNRESOLVED', 1),
            ('EXTENDS', 'shop.use.Shop', 'c.Cart', None, 'UNRESOLVED', 1),
            ('IMPORTS', 'shop', 'core.Cart', None, 'UNRESOLVED', 1),
            ('IMPORTS', 'shop', 'shop.core.price', None, 'HEURISTIC', 1),
            ('IMPORTS', 'shop.core', 'os', None, 'UNRESOLVED', 1),
            ('IMPORTS', 'shop.core', 'shop.util', None, 'HEURISTIC', 1),
            ('IMPORTS', 'shop.core', 'shop.util.clamp', None, 'HEURISTIC', 1),
            ('IMPORTS', 'shop.use', 'other.lib.thing', None, 'UNRESOLVED', 1),
            ('IMPORTS', 'shop.use', 'shop.Basket', None, 'HEURISTIC', 1),
            ('IMPORTS', 'shop.use', 'shop.absent', None, 'HEURISTIC', 1),
            ('IMPORTS', 'shop.use', 'shop.core', None, 'HEURISTIC', 2),
            ('IMPORTS', 'shop.use', 'shop.price', None, 'HEURISTIC', 1),
            ('IMPORTS', 'shop.use', 'shop.util.*', None, 'UNRESOLVED', 1),
            ('IMPORTS', 'shop.use', 'shop.util.twice', None, 'HEURISTIC', 1),
        ],
    ),
    "compile_values": (
        [('subject', 'string'), ('object_literal', 'string'), ('quote', 'string'), ('strength', 'string')],
        [
            ('run.Signer.MODE', "'fast'", "MODE = 'fast'", 'EXACT'),
            ('shop.core.Cart.NAME', '"cart"', 'NAME = "cart"', 'EXACT'),
            ('shop.core.Cart.NOTHING', 'None', 'NOTHING = None', 'EXACT'),
            ('shop.core.Cart.OPEN', 'True', 'OPEN = True', 'EXACT'),
            ('shop.core.Cart.RATIO', '0.5', 'RATIO = 0.5', 'EXACT'),
            ('shop.core.Cart.TIMEOUT', '30', 'TIMEOUT = 30', 'EXACT'),
            ('twin.Signer.MODE', "'safe'", "MODE = 'safe'", 'EXACT'),
            ('twin.Signer.MODE', "'slow'", "MODE = 'slow'", 'EXACT'),
        ],
    ),
    "compile_diagnostics": (
        [('code', 'string'), ('severity', 'string'), ('rel_path', 'string'), ('n', 'bigint')],
        [
            ('BINARY_AS_TEXT', 'WARNING', 'binary.py', 1),
            ('STAR_IMPORT', 'WARNING', 'src/shop/use.py', 1),
            ('SYNTAX_ERROR', 'ERROR', 'broken.py', 1),
            ('UNDECODABLE', 'WARNING', 'latin.py', 1),
            ('UNRESOLVED_REFERENCE', 'INFO', 'src/shop/core.py', 4),
            ('UNRESOLVED_REFERENCE', 'INFO', 'tools/twin.py', 2),
            ('UNSUPPORTED_CLASS_LITERAL', 'INFO', 'src/shop/core.py', 6),
            ('UNSUPPORTED_DECORATOR_CALL', 'INFO', 'src/shop/use.py', 1),
            ('UNSUPPORTED_LANGUAGE', 'INFO', 'data/limits.csv', 1),
            ('UNSUPPORTED_LANGUAGE', 'INFO', 'data/limits.json', 1),
            ('UNSUPPORTED_LANGUAGE', 'INFO', 'data/limits.xml', 1),
            ('UNSUPPORTED_LANGUAGE', 'INFO', 'notes.md', 1),
        ],
    ),
    "module_names": (
        [('rel_path', 'string'), ('module', 'string')],
        [
            ('__init__.py', '__root__'),
            ('a/b/c.py', 'c'),
            ('pkg/__init__.py', 'pkg'),
            ('pkg/sub/__init__.py', 'pkg.sub'),
            ('pkg/sub/mod.py', 'pkg.sub.mod'),
            ('src/lib/__init__.py', 'lib'),
            ('src/lib/a.py', 'lib.a'),
            ('src/lib/deep/b.py', 'lib.deep.b'),
            ('tools/x.py', 'x'),
            ('top.py', 'top'),
        ],
    ),
    "corpus_admission": (
        [('rel_path', 'string'), ('code', 'string'), ('language', 'string'), ('walked', 'boolean')],
        [
            ('../b.py', 'PATH_UNSAFE', 'python', False),
            ('.hidden', 'ADMITTED', None, True),
            ('/abs.py', 'PATH_UNSAFE', 'python', True),
            ('a.py', 'ADMITTED', 'python', True),
            ('big.py', 'OVERSIZE', 'python', True),
            ('c.py', 'NOT_A_FILE', 'python', True),
            ('doc.pdf', 'ADMITTED', 'pdf', True),
            ('e.TS', 'ADMITTED', 'typescript', True),
            ('edge.py', 'ADMITTED', 'python', True),
            ('late.py', 'ADMITTED', 'python', True),
            ('latin.py', 'UNDECODABLE', 'python', True),
            ('no_suffix', 'ADMITTED', None, True),
            ('nul.py', 'BINARY_AS_TEXT', 'python', True),
        ],
    ),
    "evidence_kinds": (
        [('case_name', 'string'), ('strength', 'string'), ('verified', 'boolean')],
        [
            ('drifted', None, False),
            ('element of hostile markup', None, False),
            ('element that is not there', None, False),
            ('element', 'EXACT', True),
            ('no artifact', None, False),
            ('no verifier', None, False),
            ('node of another name', None, False),
            ('node of another type', None, False),
            ('node that is not there', None, False),
            ('node', 'EXACT', True),
            ('pointer into a scalar', None, False),
            ('pointer out of range', None, False),
            ('pointer to another value', None, False),
            ('pointer', 'EXACT', True),
            ('range inside a character', None, False),
            ('range outside', None, False),
            ('range text', None, False),
            ('range without end', None, False),
            ('range', 'EXACT', True),
        ],
    ),
    "graph_audit": (
        [('rule', 'string'), ('n', 'bigint')],
        [
            ('DERIVED claims carrying model identity', 0),
            ('DETERMINISTIC references with no resolved target', 0),
            ('FAILED artifacts with no diagnostic', 0),
            ('UNRESOLVED references with a resolved target', 0),
            ('claims belonging to a FAILED artifact', 0),
            ('claims referencing missing evidence', 0),
            ('claims whose object symbol does not exist', 0),
            ('claims whose subject symbol does not exist', 0),
            ('claims without evidence', 0),
            ('evidence not referenced by any claim', 0),
            ('failed artifacts with no recorded reason', 0),
            ('literal-valued claims without a value, or pointing at a symbol', 0),
            ('reference rows with no claim', 0),
            ('runs still marked RUNNING', 1),
            ('structural claims not deterministically established', 0),
            ('symbols whose parent does not contain them in source', 0),
            ('trusted claims without verifiable evidence', 0),
        ],
    ),
    "write_rules": (
        [('claim_id', 'string'), ('rule', 'string')],
        [
            ('derived by a model', 'DERIVED claim must not have model_id'),
            ('missing evidence', 'claim references non-existent evidence'),
            ('no evidence', 'claim has no evidence'),
            ('no evidence', 'trusted claim lacks EXACT/REPRODUCIBLE evidence'),
            ('rejected', 'REJECTED claim needs a reason'),
            ('structural only', 'CONFIRMED needs EXACT/REPRODUCIBLE evidence'),
            ('structural only', 'trusted claim lacks EXACT/REPRODUCIBLE evidence'),
            ('structural proposal', 'structural predicate requires DERIVED/CONFIRMED'),
            ('unverified proposal', 'model claim has unverified evidence'),
            ('value that is a symbol', 'literal-valued claim needs object_literal and no object_id'),
            ('value without a value', 'literal-valued claim needs object_literal and no object_id'),
        ],
    ),
    "value_cases": (
        [('id', 'int'), ('verdict', 'string')],
        [
            (0, 'SAME'),
            (1, 'DIFFERENT'),
            (10, 'SAME'),
            (11, 'DIFFERENT'),
            (12, 'SAME'),
            (13, 'DIFFERENT'),
            (14, 'SAME'),
            (15, 'DIFFERENT'),
            (16, 'SAME'),
            (17, 'UNRESOLVED'),
            (18, 'SAME'),
            (19, 'DIFFERENT'),
            (2, 'SAME'),
            (20, 'DIFFERENT'),
            (21, 'UNRESOLVED'),
            (22, 'UNRESOLVED'),
            (23, 'SAME'),
            (24, 'UNRESOLVED'),
            (25, 'UNRESOLVED'),
            (26, 'UNRESOLVED'),
            (27, 'SAME'),
            (28, 'SAME'),
            (29, 'SAME'),
            (3, 'SAME'),
            (4, 'SAME'),
            (5, 'DIFFERENT'),
            (6, 'SAME'),
            (7, 'UNRESOLVED'),
            (8, 'UNRESOLVED'),
            (9, 'SAME'),
        ],
    ),
    "question_constraints": (
        [('qid', 'string'), ('status', 'string'), ('shape', 'string'), ('subject', 'string'), ('predicate', 'string'), ('property', 'string'), ('object', 'string'), ('literals', 'string'), ('scope', 'string')],
        [
            ('q01', 'PARSED', 'property', 'Cart', None, 'timeout', None, '', None),
            ('q02', 'PARSED', 'property', 'Signer', None, 'mode', None, '', 'tools/twin.py'),
            ('q03', 'PARSED', 'property', 'Signer', None, 'mode', None, '', None),
            ('q04', 'PARSED', 'property', 'Signer', None, 'mode', None, '', 'tools/run.py'),
            ('q05', 'PARSED', 'relation', 'shop.core.price', 'CALLS', None, 'helper', '', None),
            ('q06', 'PARSED', 'relation', 'shop.core.price', 'CALLS', None, 'clamp', '', None),
            ('q07', 'PARSED', 'relation', 'Shop', 'EXTENDS', None, None, '', None),
            ('q08', 'PARSED', 'relation', 'Base', 'EXTENDS', None, None, '', None),
            ('q09', 'PARSED', 'property', 'Cart', None, 'colour', None, '', None),
            ('q10', 'PARSED', 'property', 'Nowhere', None, 'timeout', None, '', None),
            ('q11', 'PARTIAL', 'interrogative_unmapped', 'I', None, None, None, '', None),
            ('q12', 'UNPARSEABLE', 'unparsed', None, None, None, None, '', None),
            ('q13', 'AMBIGUOUS', 'identifier', 'Cart', None, None, None, '', None),
            ('q14', 'PARSED', 'property', 'Cart', None, 'timeout', None, '', 'nowhere.py'),
            ('q15', 'PARSED', 'property', 'Cart', None, 'timeout', None, '30', None),
            ('q16', 'PARSED', 'property', 'Cart', None, 'timeout', None, '31', None),
            ('q17', 'PARSED', 'identifier', 'shop.core.Base', None, None, None, '', None),
            ('q18', 'PARSED', 'relation', 'Signer', 'CALLS', None, 'run', '', '__init__.py'),
            ('q19', 'PARSED', 'property', 'Cart', None, 'timeout', None, '', 'core.py'),
            ('q20', 'PARSED', 'property', 'twin.Signer', None, 'mode', None, '', None),
        ],
    ),
    "decide_questions": (
        [('qid', 'string'), ('outcome', 'string'), ('invariant', 'string')],
        [
            ('q01', 'EXPOSE', None),
            ('q02', 'EXPOSE_CONFLICTED', None),
            ('q03', 'ABSTAIN_AMBIGUOUS', 'INV-10_ambiguity'),
            ('q04', 'EXPOSE', None),
            ('q05', 'EXPOSE', None),
            ('q06', 'ABSTAIN', 'INV-3_object'),
            ('q07', 'EXPOSE', None),
            ('q08', 'ABSTAIN', 'INV-2_predicate'),
            ('q09', 'ABSTAIN', 'INV-2_predicate'),
            ('q10', 'ABSTAIN', 'INV-1_subject'),
            ('q11', 'ABSTAIN', 'INV-1_constraints'),
            ('q12', 'ABSTAIN', 'INV-1_constraints'),
            ('q13', 'ABSTAIN_AMBIGUOUS', 'INV-10_ambiguity'),
            ('q14', 'ABSTAIN', 'INV-4_scope'),
            ('q15', 'EXPOSE', None),
            ('q16', 'ABSTAIN', 'INV-3_object'),
            ('q17', 'EXPOSE', None),
            ('q18', 'ABSTAIN', 'INV-1_subject'),
            ('q19', 'EXPOSE', None),
            ('q20', 'ABSTAIN_AMBIGUOUS', 'INV-10_ambiguity'),
        ],
    ),
    "structural_verdicts": (
        [('predicate', 'string'), ('subject', 'string'), ('object', 'string'), ('verdict', 'string')],
        [
            ('CALLS', 'shop.core.price', 'clamp', 'NOT_ESTABLISHED'),
            ('CALLS', 'shop.core.price', 'helper', 'SUPPORTED'),
            ('CONTAINS', 'shop.core.Base', 'x', 'NOT_ESTABLISHED'),
            ('CONTAINS', 'shop.core.Cart', 'checkout', 'EXPLICIT_CONTRADICTION'),
            ('CONTAINS', 'shop.core.Cart', 'total', 'SUPPORTED'),
            ('EXTENDS', 'Cart', 'Base', 'SUPPORTED'),
            ('EXTENDS', 'shop.core.Cart', 'dict', 'EXPLICIT_CONTRADICTION'),
            ('WRITES', 'shop.core.Cart', 'x', 'NOT_ESTABLISHED'),
        ],
    ),
    "answers_validated": (
        [('qid', 'string'), ('outcome', 'string'), ('text', 'string')],
        [
            ('r01', 'ACCEPTED', 'price calls helper.'),
            ('r02', 'ACCEPTED', 'The timeout is 30.'),
            ('r03', 'REJECTED', None),
            ('r04', 'REJECTED', None),
            ('r05', 'REJECTED', None),
            ('r06', 'REJECTED', None),
            ('r07', 'REJECTED', None),
            ('r08', 'REJECTED', None),
            ('r09', 'REJECTED', None),
            ('r10', 'ACCEPTED', 'Cart extends Base.'),
            ('r11', 'REJECTED', None),
            ('r12', 'REJECTED', None),
        ],
    ),
    "sample_statistics": (
        [('measure', 'string'), ('key', 'string'), ('n', 'bigint')],
        [
            ('artifacts', None, 15),
            ('kind', 'class', 5),
            ('kind', 'constant', 13),
            ('kind', 'function', 13),
            ('kind', 'method', 3),
            ('kind', 'module', 8),
            ('kind', 'variable', 5),
            ('predicate', 'CALLS', 25),
            ('predicate', 'CONTAINS', 39),
            ('predicate', 'EXTENDS', 2),
            ('predicate', 'HAS_VALUE', 8),
            ('predicate', 'IMPORTS', 13),
            ('resolution', 'DETERMINISTIC', 11),
            ('resolution', 'HEURISTIC', 10),
            ('resolution', 'UNRESOLVED', 19),
            ('status', 'FAILED', 1),
            ('status', 'OK', 8),
            ('status', 'SKIPPED', 2),
            ('status', 'UNSUPPORTED', 4),
            ('symbols', None, 47),
        ],
    ),
    "search_sample": (
        [('qname', 'string'), ('kind', 'string'), ('rel_path', 'string'), ('location', 'string')],
        [
            ('run', 'module', 'tools/run.py', 'line 1, bytes 0–54'),
            ('run.Signer', 'class', 'tools/run.py', 'line 5, bytes 22–53'),
            ('run.Signer.MODE', 'constant', 'tools/run.py', 'line 6, bytes 40–53'),
            ('run.run', 'function', 'tools/run.py', 'line 1, bytes 0–19'),
            ('shop.use.run', 'function', 'src/shop/use.py', 'line 10, bytes 175–326'),
        ],
    ),
    "sample_neighbourhood": (
        [('qname', 'string'), ('depth', 'int'), ('truncated', 'boolean')],
        [
            ('shop.core.Cart.total', 1, False),
            ('shop.core.helper', 1, False),
            ('shop.core.price', 0, False),
            ('shop.use.Shop.total', 2, False),
            ('shop.use.run', 1, False),
            ('shop.util.clamp', 2, False),
        ],
    ),
    "sample_expand": (
        [('qname', 'string'), ('depth', 'int'), ('score', 'double'), ('total_reachable', 'bigint'), ('truncated', 'boolean')],
        [
            ('shop.core.price', 1, 0.229935, 5, True),
            ('shop.use.Shop.total', 2, 0.212622, 5, True),
            ('shop.use.run', 1, 0.285903, 5, True),
        ],
    ),
    "sample_facts": (
        [('predicate', 'string'), ('object', 'string'), ('resolved', 'boolean')],
        [
            ('CALLS', 'Basket', False),
            ('CALLS', 'absent', False),
            ('CALLS', 'c.nowhere', False),
            ('CALLS', 'shop.core.Cart.total', True),
            ('CALLS', 'shop.core.helper', True),
            ('CALLS', 'shop.core.price', True),
            ('CALLS', 'shop.core.price', True),
            ('CALLS', 'thing', False),
            ('CALLS', 'twice', False),
        ],
    ),
    "sample_callees": (
        [('qname', 'string'), ('kind', 'string')],
        [
            ('shop.core.Cart.total', 'method'),
            ('shop.core.helper', 'function'),
        ],
    ),
    "purge_losses": (
        [('what', 'string'), ('n', 'bigint')],
        [
            ('broken rules', 0),
            ('its symbols', 0),
            ('lost by src/shop/use.py', 4),
        ],
    ),
    "structured_records": (
        [('rel_path', 'string'), ('locator', 'string'), ('body', 'string')],
        [
            ('data/limits.csv', 'row 1', 'name=cart, timeout=30'),
            ('data/limits.csv', 'row 2', 'name=bag, timeout=40'),
            ('data/limits.json', '/deep/a/b', '/deep/a/b = x'),
            ('data/limits.json', '/sizes/0', '/sizes/0 = 1'),
            ('data/limits.json', '/sizes/1', '/sizes/1 = 2'),
            ('data/limits.json', '/timeout', '/timeout = 30'),
            ('data/limits.xml', 'line 1', '<limits>'),
            ('data/limits.xml', 'line 2', '<timeout>45</timeout>'),
            ('data/limits.xml', 'line 4', '</limits>'),
            ('notes.md', '0:7', '# Notes'),
            ('notes.md', '45:72', 'Second block\nof two lines.'),
            ('notes.md', '9:43', 'The default timeout is 30 seconds.'),
        ],
    ),
    "scope_resolution": (
        [('scope', 'string'), ('status', 'string'), ('path', 'string')],
        [
            ('./src//shop/core.py', 'EXACT', 'src/shop/core.py'),
            ('Core.py', 'UNKNOWN', None),
            ('a/same.py', 'EXACT', 'a/same.py'),
            ('core.py', 'EXACT', 'src/shop/core.py'),
            ('limits.json', 'EXACT', 'data/limits.json'),
            ('same.py', 'AMBIGUOUS', None),
            ('src/core.py', 'UNKNOWN', None),
            ('x/core.py', 'UNKNOWN', None),
        ],
    ),
    "sample_census": (
        [('measure', 'string'), ('n', 'bigint')],
        [
            ('refused', 6),
            ('stated', 8),
            ('symbols with several values', 0),
            ('verified', 8),
        ],
    ),
    "sample_identity_audit": (
        [('measure', 'string'), ('n', 'bigint')],
        [
            ('duplicate names', 2),
            ('evidence inside the subject', 87),
            ('evidence outside of a shared name', 0),
            ('evidence outside of a sole name', 0),
            ('parents that do not contain', 0),
            ('symbols sharing a name', 4),
            ('symbols without a parent', 0),
            ('symbols', 47),
        ],
    ),
    "support_gate": (
        [('qid', 'string'), ('outcome', 'string'), ('failed', 'string'), ('conflicting', 'string')],
        [
            ('g1', 'EXPOSE_CONFLICTED', None, '50,70'),
            ('g2', 'ABSTAIN', 'S2all', None),
            ('g3', 'ABSTAIN', 'S2all', None),
            ('g4', 'EXPOSE', None, None),
            ('g5', 'ABSTAIN', 'S0', None),
        ],
    ),
}

_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        text = "''".join(value.split("'"))
        return " || chr(10) || ".join(f"'{line}'" for line in text.split("\n"))
    return str(value).upper() if isinstance(value, bool) else str(value)


def sql(name: str) -> str:
    """The expected rows as a statement."""
    columns, rows = EXPECTED[name]
    names = [f"c{i}" for i in range(len(columns))]
    values = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows)
    return f"SELECT {', '.join(f'CAST({c} AS {_TYPES[t]}) AS {n}' for c, (n, t) in zip(names, columns, strict=True))} FROM (VALUES {values}) v({', '.join(names)})"
