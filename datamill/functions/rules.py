"""Rule tables, and what they say of a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of service errors, tried on the lower-cased message.
SERVICE_ERRORS = [
    r"invalidaccounterror",
    r"accountalreadyexistserror",
    r"qiskitserverlessexception",
    r"qiskit_ibm_token",
    r"ibm quantum api token",
    r"unable to retrieve instances",
    r"_verify_credentials",
]
# Patterns of outdated calls in answers and what is said of them, in order; the first that is found counts.
OUTDATED = [
    (r"qubits\[\d*\]\.index\b", 'Qubit.index removed - use circuit.find_bit(qubit).index'),
    (r"clbits\[\d*\]\.index\b", 'Clbit.index removed - use circuit.find_bit(clbit).index'),
    (r"\bq\.index\b(?!\.)", 'Qubit.index removed - use circuit.find_bit(q).index'),
    (r"\bqb\.index\b(?!\.)", 'Qubit.index removed - use circuit.find_bit(qb).index'),
    (r"\.c_if\s*\(", 'c_if removed - use QuantumCircuit.if_test() context manager'),
    (r"\.quasi_dists\b", 'quasi_dists removed - use result.data for sampler results'),
    (r"\.true_body\b", 'IfElseOp.true_body removed - use .blocks[0]'),
    (r"\.false_body\b", 'IfElseOp.false_body removed - use .blocks[1]'),
    (r"from\s+qiskit\.opflow", 'qiskit.opflow removed - use qiskit.quantum_info'),
    (r"from\s+qiskit\.pulse", 'qiskit.pulse removed in Qiskit 2.0'),
    (r"from\s+qiskit\s+import\s+.*\bpulse\b", 'qiskit.pulse removed in Qiskit 2.0'),
    (r"\.bind_parameters\s*\(", 'bind_parameters deprecated - use assign_parameters'),
    (r"qiskit\.execute\s*\(", 'qiskit.execute removed - use Sampler or Estimator'),
    (r"\.qasm\s*\(", 'qasm() removed - use qasm2.dumps() or qasm3.dumps()'),
]
# The same for tests.
OUTDATED_IN_TESTS = [
    (r"from\s+qiskit\.test", 'qiskit.test module removed'),
    (r"from\s+qiskit\.opflow", 'qiskit.opflow module removed'),
    (r"import\s+qiskit\.opflow", 'qiskit.opflow module removed'),
    (r"from\s+qiskit\s+import\s+.*pulse", 'qiskit.pulse removed'),
    (r"from\s+qiskit\.pulse", 'qiskit.pulse module removed'),
    (r"import\s+qiskit\.pulse", 'qiskit.pulse module removed'),
    (r"from\s+qiskit\.primitives\s+import\s+.*BaseEstimator", 'BaseEstimator removed - use StatevectorEstimator'),
    (r"from\s+qiskit\.primitives\s+import\s+.*BaseSampler", 'BaseSampler removed - use StatevectorSampler'),
    (r"from\s+qiskit\.primitives\s+import\s+(?!.*Statevector).*\bSampler\b", 'Sampler removed - use StatevectorSampler'),
    (r"from\s+qiskit\.primitives\s+import\s+(?!.*Statevector).*\bEstimator\b", 'Estimator removed - use StatevectorEstimator'),
    (r"from\s+qiskit\.primitives\.utils\s+import\s+.*_circuit_key", '_circuit_key is internal API'),
    (r"from\s+qiskit\.circuit\s+import\s+.*\bXGate\b", 'XGate import changed - use from qiskit.circuit.library'),
    (r"from\s+qiskit\s+import\s+.*\bParameter\b", 'Parameter import changed - use from qiskit.circuit'),
    (r"from\s+qiskit\.circuit\s+import\s+.*ClassicalBit\b", 'ClassicalBit removed - use Clbit'),
    (r"from\s+qiskit\.providers\.fake_provider\s+import\s+.*FakeVigo", 'FakeVigo removed - use qiskit_ibm_runtime.fake_provider'),
    (r"from\s+qiskit\.circuit\.library\s+import\s+.*random_clifford", 'random_clifford moved to qiskit.quantum_info'),
    (r"\.bind_parameters\s*\(", 'bind_parameters deprecated - use assign_parameters'),
    (r"qiskit\.execute\s*\(", 'qiskit.execute removed - use primitives'),
    (r"from\s+qiskit\s+import\s+.*execute", 'execute removed - use primitives'),
    (r"\.operation\.qubits", 'use circuit_instruction.qubits not .operation.qubits'),
    (r"\.operation\.clbits", 'use circuit_instruction.clbits not .operation.clbits'),
    (r"qubits\[\d*\]\.index\b", 'Qubit.index removed - use circuit.find_bit(qubit).index'),
    (r"clbits\[\d*\]\.index\b", 'Clbit.index removed - use circuit.find_bit(clbit).index'),
    (r"\bq\.index\b(?!\.)", 'Qubit.index removed - use circuit.find_bit(q).index'),
    (r"\bqb\.index\b(?!\.)", 'Qubit.index removed - use circuit.find_bit(qb).index'),
    (r"\bqubit\.index\b", 'Qubit.index removed - use circuit.find_bit(qubit).index'),
    (r"\bclbit\.index\b", 'Clbit.index removed - use circuit.find_bit(clbit).index'),
    (r"\.c_if\s*\(", 'c_if removed - use if_test or QuantumCircuit.if_test'),
    (r"\.quasi_dists", 'quasi_dists removed - use result.data structure'),
    (r"StatevectorSampler\s*\([^)]*backend\s*=", 'StatevectorSampler does not accept backend argument'),
    (r"StatevectorEstimator\s*\([^)]*backend\s*=", 'StatevectorEstimator does not accept backend argument'),
    (r"IBMProvider\s*\(", 'IBMProvider removed - use QiskitRuntimeService'),
    (r"from\s+qiskit\s+import\s+.*IBMQ", 'IBMQ removed - use QiskitRuntimeService'),
    (r"IBMQ\.load_account", 'IBMQ removed - use QiskitRuntimeService'),
    (r"excitation_preserving\s*\([^)]*flatten\s*=", 'excitation_preserving flatten argument removed'),
    (r"QuantumCircuit\.\w+\s*\([^)]*condition\s*=", 'condition argument removed - use if_test'),
    (r"\.true_body\b", 'IfElseOp.true_body removed - use .blocks[0]'),
    (r"\.false_body\b", 'IfElseOp.false_body removed - use .blocks[1]'),
    (r"Statevector\([^)]*\)\.adjoint(?!\()", 'use .adjoint() method not property'),
    (r"\.qasm\s*\(", 'QuantumCircuit.qasm() removed - use qasm2.dumps() or qasm3.dumps()'),
    (r"ZFeatureMap\s*\(\s*num_qubits\s*=", 'ZFeatureMap uses positional feature_dimension, not num_qubits kwarg'),
    (r"ZZFeatureMap\s*\(\s*num_qubits\s*=", 'ZZFeatureMap uses positional feature_dimension, not num_qubits kwarg'),
    (r"assert\s+.*\s+is\s+.*\.qubits\[", "Use == not 'is' for qubit comparison - objects are not identical"),
    (r"assert\s+.*\.qubits\[\d+\]\s+is\s+", "Use == not 'is' for qubit comparison - objects are not identical"),
    (r"from\s+qiskit_machine_learning\.utils\s+import\s+algorithm_globals", 'algorithm_globals import changed in qiskit_machine_learning'),
]
# Code that isn't let into a sandbox.
DANGEROUS = [
    r"os\.environ",
    r"environ\[",
    r"getenv\s*\(",
    r"\bctypes\b",
    r"\bpickle\b",
    r"\bmarshal\b",
    r"\bshelve\b",
    r"\bcommands\b",
    r"\bpty\b",
    r"\bpexpect\b",
    r"\bos\.system\b",
    r"\bos\.popen\b",
    r"\bos\.spawn",
    r"\bos\.exec",
    r"\bos\.fork\b",
    r"\bsubprocess\b",
    r"\bcommands\b",
    'open\\s*\\(\\s*[\'"]\\s*/etc',
    'open\\s*\\(\\s*[\'"]\\s*/proc',
    'open\\s*\\(\\s*[\'"]\\s*/sys',
    'open\\s*\\(\\s*[\'"]\\s*/dev',
    'open\\s*\\(\\s*[\'"]\\s*/var',
    'open\\s*\\(\\s*[\'"]\\s*/root',
    'open\\s*\\(\\s*[\'"]\\s*/home',
    'open\\s*\\(\\s*[\'"]\\s*/tmp',
    'open\\s*\\(\\s*[\'"]\\s*\\.env',
    'open\\s*\\(\\s*[\'"]\\s*\\.\\./',
    'open\\s*\\(\\s*f?[\'"]\\s*\\{',
    r"\bsocket\b",
    r"\burllib\b",
    r"\brequests\b",
    r"\bhttpx\b",
    r"\baiohttp\b",
    r"\bhttp\.client\b",
    r"\bftplib\b",
    r"\bsmtplib\b",
    r"\btelnetlib\b",
    r"\bparamiko\b",
    r"\beval\s*\(",
    r"\bexec\s*\(",
    r"\bcompile\s*\(",
    r"\b__import__\b",
    r"\bimportlib\b",
    r"\bbuiltins\b",
    r"\bglobals\s*\(\s*\)",
    r"\blocals\s*\(\s*\)",
    '\\bgetattr\\s*\\([^,]+,\\s*[\'"]',
    r"\bsetattr\s*\(",
    r"\bdelattr\s*\(",
    r"\b__class__\b",
    r"\b__bases__\b",
    r"\b__subclasses__\b",
    r"\b__mro__\b",
    r"\b__globals__\b",
    r"\b__code__\b",
    r"\b__reduce__\b",
    r"\b__getstate__\b",
    r"\b__setstate__\b",
    r"\bmultiprocessing\b",
    r"\bthreading\b",
    r"\bconcurrent\b",
    r"\basyncio\.subprocess",
]
# User input that is refused, and words of the topics that are welcome.
REFUSED = [
    r"(?i)ignore\s+(previous|all|above|prior)\s+(instructions?|prompts?|rules?)",
    r"(?i)disregard\s+(previous|all|above|prior)",
    r"(?i)forget\s+(everything|all|your)\s+(instructions?|rules?|training)",
    r"(?i)new\s+instructions?:",
    r"(?i)system\s*prompt",
    r"(?i)jailbreak",
    r"(?i)dan\s*mode",
    r"(?i)pretend\s+(you\s+are|to\s+be)",
    r"(?i)act\s+as\s+(if|a)",
    r"(?i)roleplay\s+as",
    r"(?i)you\s+are\s+now",
    r"(?i)how\s+to\s+(hack|attack|exploit|break\s+into)",
    r"(?i)malware|virus|trojan|ransomware",
    r"(?i)steal\s+(data|information|credentials|password)",
    r"(?i)bypass\s+(security|authentication|firewall)",
    r"(?i)injection\s+attack",
    r"(?i)sql\s+injection",
    r"(?i)xss|cross.?site",
    r"(?i)bypass\s+(filter|restriction|limitation|safety)",
    r"(?i)disable\s+(safety|filter|moderation)",
    r"(?i)unlock\s+(hidden|secret|restricted)",
    r"(?i)override\s+(rules?|restrictions?)",
    r"(?i)write\s+(me\s+)?(a\s+)?(story|poem|essay|article|blog)",
    r"(?i)tell\s+me\s+(a\s+)?joke",
    r"(?i)relationship\s+advice",
    r"(?i)dating\s+advice",
    r"(?i)political\s+opinion",
    r"(?i)investment\s+advice",
    r"(?i)medical\s+(advice|diagnosis)",
    r"(?i)legal\s+advice",
]
TOPICS = [
    "quantum", "qubit", "qubits", "superposition", "entanglement", "measurement", "circuit", "gate",
    "hadamard", "cnot", "pauli", "rotation", "phase", "bloch", "sphere", "state",
    "vector", "amplitude", "probability", "algorithm", "grover", "shor", "vqe", "qaoa",
    "qft", "fourier", "error", "correction", "noise", "decoherence", "fidelity", "mitigation",
    "transpiler", "transpile", "optimization", "compilation", "qiskit", "ibm", "aer", "simulator",
    "backend", "provider", "runtime", "sampler", "estimator", "primitive", "job", "result",
    "counts", "quantumcircuit", "classicalregister", "quantumregister", "pass", "manager", "layout", "routing",
    "scheduling", "physics", "mechanics", "hamiltonian", "unitary", "hermitian", "operator", "eigenvalue",
    "eigenvector", "matrix", "tensor", "linear", "algebra", "hilbert", "space", "basis",
    "orthogonal", "projection", "complex", "number", "exponential", "trigonometric", "probability", "distribution",
    "expectation", "variance", "wave", "function", "schrodinger", "dirac", "bra", "ket",
    "notation", "machine", "learning", "variational", "ansatz", "parameter", "parametrized", "optimization",
    "gradient", "descent", "cost", "function", "loss", "training", "classical", "hybrid",
    "neural", "kernel", "numpy", "scipy", "matplotlib", "plot", "histogram", "visualization",
    "array", "matrix", "calculation", "computation", "simulation", "python", "code", "function",
    "class", "import", "library", "example", "tutorial", "explain", "how", "what",
    "why", "help", "implement", "create", "build", "make", "generate", "write",
]
# Leads of questions, and signs of drawn circuits in code and output.
QUESTION = r"(?i)^(what|how|why|when|where|can|could|would|should|is|are|do|does|explain|describe|help|show|create|implement|write|generate|build|make)"
CODE_CONTEXT = r"(?i)```|def\s|import\s|class\s|function|circuit"
DRAWING_CODE = [r"\.draw\(", r"circuit_drawer", r"plot_histogram", r"plot_bloch", r"\.decompose\(\)", r"(?i)print.*circuit"]
DRAWN = [r"[┌─┬┐│├┼┤└┴┘═║╔╗╚╝]", r"q\d*.*[─┤├]", r"[HXYZTSRx].*├"]
LONGEST_INPUT = 10_000


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in patterns])


def first_message(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The message of the first rule whose pattern is found; null for none."""
    return F.coalesce(*[F.when(F.rlike(text, F.lit(p)), m) for p, m in rules])


def service_error(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in SERVICE_ERRORS])


def without_comments(code: Column) -> Column:
    for pattern in (r"(?m)#.*$", r"(?s)'''.*?'''", r'(?s)""".*?"""'):
        code = F.regexp_replace(code, pattern, "")
    return code


def one_pattern(patterns: list[str]) -> str:
    """A pattern for any of several that begin with a letter or an underscore, after a word boundary or anywhere; looked for by those letters first."""
    kinds = [(lead, [p.removeprefix(lead) for p in patterns if p.startswith(r"\b") == bool(lead)]) for lead in (r"\b", "")]
    return "|".join(f"{lead}(?=[{''.join(sorted({r[0] for r in rest}))}])(?:{'|'.join(rest)})" for lead, rest in kinds if rest)


def dangerous(code: Column) -> Column:
    """Is there a dangerous pattern outside comments and long strings? Those are taken out once, and the text is searched once."""
    return F.rlike(without_comments(code), F.lit(one_pattern(DANGEROUS)))


def draws_circuit(code: Column, output: Column) -> Column:
    return matches_any(code, DRAWING_CODE) | matches_any(output, DRAWN)


def input_check(text: Column) -> Column:
    """struct(valid, off_topic, reason) of a user's message."""
    refused, too_long = matches_any(text, REFUSED), F.length(text) > LONGEST_INPUT
    words = F.split(F.lower(text), r"\s+")
    topics = F.array(*map(F.lit, TOPICS))
    on_topic = F.exists(words, lambda w: F.exists(topics, lambda t: F.contains(w, t) | F.contains(t, w)))
    free = F.contains(text, F.lit("[IMAGE]")) | (F.length(text) <= 50)
    known = on_topic | F.rlike(F.lower(F.trim(text)), F.lit(QUESTION)) | F.rlike(text, F.lit(CODE_CONTEXT))
    valid = ~refused & ~too_long
    return F.struct(
        valid.alias("valid"), (valid & ~free & ~known).alias("off_topic"), F.when(refused, "refused").when(too_long, "too long").alias("reason")
    )
